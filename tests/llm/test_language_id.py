from __future__ import annotations

import math
import zlib

import duckdb
import numpy as np
import pytest
from helpers import DOCS, no_docs, odd_docs, with_clashes

from twinsift.llm import language_id as L


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6, 20, 100])
def test_codewords_differ(k):
    c = L.codewords(k)
    assert c.shape[0] == k
    assert set(np.unique(c)) <= {-1.0, 1.0}
    if k > 1:
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= max(1, c.shape[1] // 4)


def test_one_wrong_bit_is_corrected():
    model = L.LanguageModel(["a", "b", "c", "d"], L.codewords(4), np.zeros((L.BUCKETS, 7), np.float32), np.zeros(7), np.ones(7))
    for i in range(4):
        for bit in range(7):
            z = model.codes[i] * 3
            z[bit] *= -1
            model.bias = z
            assert model.predict(["x"])["lang_pred"] == [model.langs[i]]


def test_held_out_accuracy():
    rows = duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 4 == 2
    model = L.fit([(r[1], r[2]) for r in rows if not held(r)])
    test = [r for r in rows if held(r)]
    got = model.predict([r[1] for r in test])
    assert np.mean([p == r[2] for p, r in zip(got["lang_pred"], test, strict=True)]) > 0.97


def test_odd_rows(spark, docs):
    model = L.learn(docs)
    got = L.identify(with_clashes(odd_docs(spark)), model)
    rows = {r["doc_id"]: r for r in got.where("doc_id IS NOT NULL").collect()}
    assert got.count() == odd_docs(spark).count()
    for i in (100, 101, 102):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["ambiguous"]) == ("und", 0.0, True)
    assert rows[103]["lang_pred"] in model.langs
    assert rows[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2)
    assert got.where("score < 0 OR score > 1 OR lang_pred IS NULL OR held_out IS NULL").count() == 0
    assert L.identify(no_docs(spark), model).count() == 0


def test_few_languages_or_none(spark):
    assert L.fit([]).predict(["text"])["lang_pred"] == ["und"]
    assert L.fit([("a b c", "xx")]).predict(["text", "1 2"])["lang_pred"] == ["xx", "und"]
    frame = spark.createDataFrame([(1, "no language", None, None, None)], DOCS)
    assert L.identify(frame, L.learn(frame)).first()["lang_pred"] == "und"


def test_long_texts_are_counted_in_pieces():
    text = "the quick brown fox " * 120_000
    whole = np.frombuffer(f" {text} ".encode(), np.uint8)
    assert len(whole) > 1 << 21
    assert np.allclose(L.features([text]), L.features(["the quick brown fox " * 1000]), atol=0.01)


def test_rare_languages_are_learned_and_only_the_most_frequent_of_too_many(spark, monkeypatch):
    rows = [(i, f"the common words {i} of one", "aa", "s", 1) for i in range(4000)] + [(i, f"zzyq xxwv {i} qqzz", "rare", "s", 1) for i in range(4000, 4020)]
    frame = spark.createDataFrame(rows, DOCS)
    assert L.learn(frame).langs == ["aa", "rare"]
    monkeypatch.setattr(L, "CLASSES", 1)
    assert L.learn(frame).langs == ["aa"]


def test_the_query_equals_brute_force(spark, small, docs):
    from twinsift.llm.registry import QUERIES

    model = L.learn(docs)
    w, bias, codes, trust = model.weights.tolist(), model.bias.tolist(), model.codes.tolist(), model.trust.tolist()

    def brute(text: str) -> tuple[str, float]:
        b = f" {L.ascii_lower(text)} ".encode()
        counts: dict[int, int] = {}
        for n, by, mix in ((2, (257,), 2654435761), (3, (257, 263), 2246822519)):
            for i in range(len(b) - n + 1):
                v = b[i]
                for k, m in enumerate(by, 1):
                    v = (v * m + b[i + k]) % 2**32
                bucket = v * mix % 2**32 >> 19
                counts[bucket] = counts.get(bucket, 0) + 1
        n = sum(counts.values())
        z = [bias[j] + sum((c / n) ** 0.5 * w[k][j] for k, c in counts.items()) for j in range(len(bias))]
        loss = [sum(t * math.log1p(math.exp(-x * c)) for x, c, t in zip(z, row, trust, strict=True)) for row in codes]
        p = [math.exp(min(loss) - v) for v in loss]
        return model.langs[loss.index(min(loss))], max(p) / sum(p)

    got = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, small).collect()}
    for r in [r for r in docs.collect() if L.LETTER.search(r["text"] or "") and len(r["text"]) < 4000]:
        lang, score = brute(r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-3)
