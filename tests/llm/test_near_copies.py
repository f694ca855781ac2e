from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from helpers import DOCS, lower, no_docs, odd_rows, with_clashes

from twinsift.llm import near_copies as N
from twinsift.llm import simhash as S


def brute_set(text: str | None) -> frozenset:
    w = lower(text or "").replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows: list[tuple]) -> list:
    sets = sorted({brute_set(r[1]) for r in rows}, key=lambda s: sorted(s))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) > 0:
                up[find(i)] = find(j)
    least: dict = {}
    for r in rows:
        k = find(sets.index(brute_set(r[1])))
        least[k] = min([x for x in (r[0], least.get(k)) if x is not None], default=None)
    return sorted(map(repr, least.values()))


def edited(words: list[str], places: list[int]) -> str:
    return " ".join("changed" if i in places else w for i, w in enumerate(words))


@pytest.fixture(scope="module")
def rows():
    """Odd rows, and texts with one to many words changed: on both sides of the limit, and chains across it."""
    rng = random.Random(3)
    out = odd_rows(n=30)
    for k in range(4):
        words = [f"w{rng.randrange(10_000)}" for _ in range(100 + 40 * k)]
        out += [(1000 * (k + 1) + n, edited(words, rng.sample(range(len(words)), n % 9)), "en", "s0", 1) for n in range(40)]
        out += [(1000 * (k + 1) + 500 + n, " ".join(words[n * 4 :]), "en", "s0", 1) for n in range(12)]
    return out


def test_kept_rows_equal_brute_force(spark, rows):
    """The index may miss a link beyond 13 bits; here chains and stars make up for that."""
    frame = with_clashes(spark.createDataFrame(rows, DOCS))
    got = N.keep_one(frame)
    assert got.columns == frame.columns
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == brute_kept(rows)


def test_large_clusters_in_parts(spark, rows, monkeypatch):
    frame = spark.createDataFrame([(k, r[1], "en", "s0", 1) for k, r in enumerate(rows)], DOCS)
    whole = {(r["key"], r["root"]) for r in N.groups(frame).collect()}
    assert {(r["key"], r["root"]) for r in N.groups(frame, part=5).collect()} == whole


def test_links_that_are_certain_are_found_and_unlike_texts_are_not_linked(spark, rows):
    sets = {k: brute_set(r[1]) for k, r in enumerate(rows)}
    ids = [(k, r[1], "en", "s0", 1) for k, r in enumerate(rows)]
    prints = {k: N.Shingles(r[1] or "").fingerprint() for k, r in enumerate(rows)}
    keys = {k: N.signature(r[1] or "")[0] for k, r in enumerate(rows)}
    root = {r["key"]: r["root"] for r in N.groups(spark.createDataFrame(ids, DOCS)).collect()}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
                if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= 13:
                    assert root[keys[i]] == root[keys[j]]
    of: dict = {}
    for k in sets:
        assert of.setdefault(root[keys[k]], find(k)) == find(k)


@pytest.mark.parametrize("leaf", [50_000, 20])
def test_candidates_equal_brute_force(spark, leaf):
    """With leaves of 20 almost all nodes are searched in parts."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (12, 2), dtype=np.uint64)[rng.integers(0, 12, 300)]
    for _ in range(9):
        base = base ^ (np.uint64(1) << rng.integers(0, 64, (300, 2), dtype=np.uint64))
    f = np.unique(base, axis=0)
    frame = spark.createDataFrame(f.view(np.int64).tolist(), "f long, g long")
    got = {r["node"]: r["root"] for r in N.components(N._candidates(frame, N.LIMIT, N.BLOCKS, N.AGREE, leaf)).collect()}
    names = N.vertex(f[:, 0].view(np.int64), f[:, 1].view(np.int64)).tolist()
    up = list(range(len(f)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    masks = [np.uint64(m & S.ALL) for m in N.masks_for()]
    for i in range(len(f)):
        for j in range(i):
            x = f[i] ^ f[j]
            if int(np.bitwise_count(x).sum()) <= N.LIMIT and any(not (w & m) for w in x for m in masks):
                up[find(i)] = find(j)
    mine, theirs = {}, {}
    for i, n in enumerate(names):
        mine.setdefault(got.get(n, n), []).append(i)
        theirs.setdefault(find(i), []).append(i)
    assert sorted(mine.values()) == sorted(theirs.values())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 40])
def test_votes(n):
    words = [f"w{k % 7}" for k in range(n)]
    s = N.Shingles(" ".join(words))
    h = np.array([xxhash.xxh64_intdigest(w, N.SEED) for w in words], np.uint64)
    three = N.joined(h, 3) if n >= 3 else N.joined(h, n) if n else h
    votes = [sum(int(x) >> b & 1 for x in some) for some in (three, N.mixed(three ^ N.FACTORS[63])) for b in range(63, -1, -1)]
    assert s.votes.tolist() == votes
    assert s.n == len(three)
    five = N.joined(h, 5) if n >= 5 else N.joined(h, n) if n else h
    assert s.set.tolist() == sorted(set(five.tolist()))


def test_the_stage_drops_edited_copies(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words), "en", "s0", 1), (2, edited(words, [40, 150, 260]), "en", "s0", 1), (3, edited(words, list(range(0, 300, 9))), "en", "s0", 1)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.unique(spark, spark.createDataFrame(rows, DOCS), "").collect()) == [1, 3]


def test_no_rows_and_no_words(spark):
    assert N.keep_one(no_docs(spark)).count() == 0
    assert N.keep_one(spark.createDataFrame([(None, None, None, None, None), (None, " ", None, None, None), (4, "", None, None, None)], DOCS)).collect()[0]["doc_id"] == 4


def test_shingles_of_pieces(monkeypatch, rows):
    whole = [N.Shingles(r[1] or "") for r in rows[:20]]
    cut = N.pieces
    monkeypatch.setattr(N, "pieces", lambda t: cut(t, 9))
    for r, w in zip(rows[:20], whole, strict=True):
        got = N.Shingles(r[1] or "")
        assert (got.set == w.set).all() and got.fingerprint() == w.fingerprint()
