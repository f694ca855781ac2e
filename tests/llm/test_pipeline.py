from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import pytest
import sentencepiece
from oracle import rows_of_frame, rows_of_sql
from test_near_copies import brute_kept

from twinsift.llm import mixing, quality_crf, toxicity
from twinsift.llm.registry import ORACLES, QUERIES, tokenizer


def brute_mix(rows: list[tuple]) -> Counter:
    """How often each (doc_id, text) comes: the schedule, the lines and the blocks in plain loops. rows: doc_id, source, text."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda r: hashlib.md5(f"17:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    held = [sum(size(r[2]) for r in rows if r[1] == s) for s in sources]
    weight, total = [1 + k % 3 for k in range(len(sources))], sum(held)
    capped: set[int] = set()
    while True:  # sources above three times their size stop there, the others share what is left
        left, rest = total - 3 * sum(held[k] for k in capped), sum(w for k, w in enumerate(weight) if k not in capped)
        more = {k for k in range(len(sources)) if k not in capped and Fraction(weight[k] * left, rest) >= 3 * held[k]}
        if not more:
            break
        capped |= more
    take = [3 * held[k] if k in capped else weight[k] * left // rest for k in range(len(sources))]
    words, n = sum(take), mixing.slots_for(sum(take))
    edges = [sum(take[:k]) * mixing.RANGE // max(1, words) for k in range(len(take) + 1)]
    slots = Counter(next(k for k in range(len(take)) if edges[k] <= i * mixing.GOLDEN % mixing.RANGE < edges[k + 1]) for i in range(n))
    out: Counter = Counter()
    for k, s in enumerate(sources):
        line = [w for r in sorted((r for r in rows if r[1] == s), key=key) for w in [r] * size(r[2])] * 3
        upto = slots[k] * words // n
        for p in range(3):
            got = Counter(line[p * held[k] : min(upto, (p + 1) * held[k])])
            for r, c in got.items():
                out[r[0], r[2]] += 2 * c >= size(r[2])
    return +out


def test_each_stage_equals_brute_force(spark, small, docs, labels, tmp_path):
    now, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, small).write.parquet(str(tmp_path / str(k)))
        was, now = now.collect(), spark.read.parquet(str(tmp_path / str(k)))
        rows = now.collect()
        seen[name] = len(rows)
        if k < 4:
            assert now.columns == docs.columns
        got = sorted((tuple(r) for r in rows), key=repr)
        if name == "quality classifier":
            field = quality_crf.learn(docs, labels)
            assert got == sorted((tuple(r) for r in was if field.score([r["text"] or ""])["predicted"] == [1]), key=repr)
        elif name == "toxicity":
            model = toxicity.learn(spark.read.parquet(str(tmp_path / "0")), labels)
            assert got == sorted((tuple(r) for r in was if model.score(r["text"] or "")[1] == 0), key=repr)
        elif name == "simhash near-dedup":
            assert sorted(repr(r["doc_id"]) for r in rows) == brute_kept([(r["doc_id"], r["text"]) for r in was])
            assert {tuple(r) for r in rows} <= {tuple(r) for r in was}
        elif name == "mixing":
            assert Counter((r["doc_id"], r["text"]) for r in rows) == brute_mix([(r["doc_id"], r["source"], r["text"]) for r in was])
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
            assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((r["doc_id"], tuple(library.encode(r["text"] or "", num_threads=1))) for r in was)
            assert all(r["same"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert docs.count() > seen["quality classifier"] >= seen["toxicity"] > seen["simhash near-dedup"]
    assert seen["mixing"] == seen["sentencepiece"]


def test_stages_take_odd_rows_one_after_another(spark, small, tmp_path):
    from helpers import no_docs, odd_docs, with_clashes

    for part, first in (("odd", with_clashes(odd_docs(spark))), ("none", no_docs(spark))):
        now = first
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, now, small)
            if k < 4:
                assert got.columns == first.columns
            got.write.parquet(str(tmp_path / part / str(k)))
            now = spark.read.parquet(str(tmp_path / part / str(k)))
        assert (now.count() == 0) == (part == "none")


def test_bad_documents_go_and_good_ones_stay(spark, small, docs, labels):
    kept = corpus_pipeline.quality(spark, docs, small).join(labels, "doc_id").groupBy("quality").count().collect()
    all_ = {r["quality"]: r["count"] for r in docs.join(labels, "doc_id").groupBy("quality").count().collect()}
    got = {r["quality"]: r["count"] for r in kept}
    assert got[1] >= 0.95 * all_[1]
    assert got.get(0, 0) <= 0.2 * all_[0]


def test_run_gives_the_last_stages_rows(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert {"doc_id", "ids", "n_pieces", "same"} <= set(got.columns)
    assert got.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, small, name):
    assert rows_of_frame(QUERIES[name](spark, small)) == rows_of_sql(ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_each_query_covers_its_table(spark, small, name):
    table = "conversations" if name.startswith("op2_") else "documents"
    rows = spark.read.parquet(f"{small}/{table}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert QUERIES[name](spark, small).count() == want
