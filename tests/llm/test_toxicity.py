from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from helpers import no_docs, odd_docs, with_clashes

from twinsift.llm import toxicity as T


@pytest.fixture(scope="module")
def fitted(labelled_rows):
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 3 == 1
    return T.fit([(r[1], r[3]) for r in labelled_rows if not held(r)]), [r for r in labelled_rows if held(r)]


def test_held_out_accuracy(fitted):
    model, test = fitted
    p = np.array([model.score(r[1])[1] for r in test])
    y = np.array([r[3] for r in test])
    assert (p == y).mean() > 0.92  # about 300 toxic documents to learn from; with 1,400 some 96 % are found
    assert p[y == 1].mean() > 0.4
    assert p[y == 0].mean() < 0.02


def test_lengths_that_the_dictionaries_give():
    d = T.Distance(b"plain words of ordinary talk " * 8, b" zyxwvutsrq qrstuvwxyz ")
    assert d.gap(b" zyxwvutsrq ") > 2
    assert abs(d.gap(b" ordinary talk ")) <= 1
    assert d.measure("ordinary talk zyxwvutsrq of words").max() > 0


def test_windows():
    assert list(T.windows("a b c d e", 2)) == [b" a b ", b" c d ", b" e "]
    assert list(T.windows("a b c d e", 3, 1)) == [b" a b c ", b" b c d ", b" c d e "]
    assert list(T.windows("", 2)) == list(T.windows(" \n", 2, 1)) == [b"  "]
    assert list(T.windows("a", 4, 2)) == [b" a "]
    assert [len(w) for w in T.windows("x" * 1000, 2)] == [515, 491]


def test_passages_that_toxic_documents_share_are_found():
    """Planted strings are recurrent in one class only; the dictionary that is left holds them and little else."""
    rng = np.random.default_rng(1)
    make = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))
    plain = [make() for _ in range(300)]
    toxic = [f"{make()} {rng.choice(['zqzvwx kjw', 'wvvyzz qqk'])} {make()}" for _ in range(200)]
    found = b"".join(T.purified(plain, toxic))
    assert b"zqzvwx" in found
    assert b"wvvyzz" in found


def test_the_query_equals_brute_force(spark, small, docs, labels):
    import zstandard

    from twinsift.llm.registry import QUERIES

    model = T.learn(docs, labels)

    def size(b: bytes, content: bytes) -> int:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(T.LEVEL, source_size=512, dict_size=T.ORDINARY + max(T.TOXIC), min_match=T.MATCH, write_content_size=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(b))

    def brute(text: str) -> float:
        ws = [w[k : k + 256] for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower()) for k in range(0, len(w), 256)]
        bs = [f" {' '.join(ws[i : i + 16])} ".encode() for i in range(0, len(ws), 16)] or [b"  "]
        g = [size(b, model.measure.ordinary) - size(b, model.measure.toxic + model.measure.ordinary) for b in bs]
        n, top = len(g), sorted(g, reverse=True)
        x = [top[0], sum(top[:3]) / len(top[:3])]
        x += [sum(max(v - t, 0) for v in g) / n**0.5 for t in (1, 2, 3)] + [sum(v >= t for v in g) / n**0.5 for t in (1, 2, 3, 4)]
        x += [math.log1p(sum(v >= t for v in g)) for t in (1, 2, 3, 4)] + [math.log(n)]
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=False)) + model.weights[-1]
        return 1 / (1 + math.exp(-max(-40, min(40, z))))

    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, small).collect()}
    short = [r for r in docs.collect() if len(r["text"] or "") < 3000]
    assert len(short) > 100
    for r in short:
        p = brute(r["text"] or "")
        assert got[r["doc_id"]]["score"] == pytest.approx(p, abs=1e-9)
        assert got[r["doc_id"]]["predicted"] == (p >= 0.7)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_windows_do_not_depend_on_pieces(fitted, monkeypatch):
    model, test = fitted
    text = test[0][1]
    whole = model.measure.statistics(text)
    cut = T.pieces
    monkeypatch.setattr(T, "pieces", lambda t: cut(t, 50))
    assert model.measure.statistics(text) == whole


def test_odd_rows(spark, fitted):
    model, _ = fitted
    rows = odd_docs(spark)
    got = T.score_toxicity(with_clashes(rows), model)
    assert got.count() == rows.count()
    assert got.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> CAST(score >= 0.7 AS INT) OR held_out IS NULL").count() == 0
    assert {r["predicted"] for r in got.where("doc_id IN (100, 101, 102)").collect()} == {0}
    assert T.drop_toxic(with_clashes(rows), model).columns == with_clashes(rows).columns
    assert T.score_toxicity(no_docs(spark), model).count() == 0


def test_nothing_to_learn_from(spark, labels):
    model = T.learn(no_docs(spark), labels.limit(0))
    assert model.score("any text")[1] == 0
    assert T.fit([("one text", 0), ("other text", 1)]).score("text")[1] in (0, 1)


def test_the_same_rows_give_the_same_model(labelled_rows):
    rows = [(r[1], r[3]) for r in labelled_rows[:300]]
    a, b = T.fit(rows), T.fit(rows)
    assert a.measure.toxic == b.measure.toxic
    assert np.array_equal(a.weights, b.weights)
