from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import DOCS, lower, no_docs, odd_docs, odd_rows, table, with_clashes

from twinsift.llm import simhash as S


def brute_print(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    votes = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(parts))


def brute_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, fp, least id reachable, a name of the component) by comparing all pairs of fingerprints."""
    prints = sorted({fp for _, fp in rows})
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    least: dict = {}
    for d, fp in rows:
        k = find(fp)
        least[k] = min([x for x in (d, least.get(k)) if x is not None], default=None)
    return [(d, f"{fp:016x}", least[find(fp)], find(fp)) for d, fp in rows]


@pytest.mark.parametrize("text", ["", " \n", None, "One", "a B", "a b c", "É b C d é", "x y z x y z x y z", "one two  three\tfour\x0bfive"])
def test_fingerprint(text):
    assert S.fingerprint(text or "") == brute_print(text)


def test_fingerprint_of_pieces(monkeypatch):
    cut = S.pieces
    monkeypatch.setattr(S, "pieces", lambda t: cut(t, 9))
    for r in odd_rows(n=20)[:20]:
        assert S.fingerprint(r[1]) == brute_print(r[1])


def family(seed: int, n: int, flips: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 2**64, size=6, dtype=np.uint64)[rng.integers(0, 6, n)]
    for _ in range(flips):
        f = np.where(rng.random(n) < 0.5, f ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)), f)
    return np.unique(f)


@pytest.mark.parametrize("seed", range(6))
def test_the_tree_finds_all_links_within_groups(seed):
    f = family(seed, 400)
    g = np.sort(np.random.default_rng(seed).integers(0, 3, len(f)))
    order = np.lexsort((S.gray_rank(f), g))
    f, g = f[order], g[order]
    got = sorted((i, j) for a, b in S.GrayTree(f, g).links(chunk=50) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    near = (np.bitwise_count(f[:, None] ^ f[None]) <= 2) & (g[:, None] == g[None])
    assert got == [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.where(near)), strict=True) if i < j]


def test_gray_rank():
    assert S.gray_rank(np.array([k ^ k >> 1 for k in range(100)], dtype=np.uint64)).tolist() == list(range(100))


@pytest.mark.parametrize("leaf", [50_000, 3])
def test_components_of_prints(spark, leaf):
    """With a leaf of 3 almost every node is refined, down to the last level."""
    prints = sorted(set(family(9, 300).tolist()) | {0, 1, 3, 7, (1 << 63) | 7, (1 << 64) - 1})
    frame = spark.createDataFrame([(S.signed(p),) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in S.components(S.linked(frame, leaf)).collect()}
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    mine: dict = {}
    for i, p in enumerate(prints):
        mine.setdefault(roots.get(S.signed(p), S.signed(p)), []).append(i)
    theirs: dict = {}
    for i, _, least, _ in want:
        theirs.setdefault(least, []).append(i)
    assert sorted(mine.values()) == sorted(theirs.values())


def test_components_of_long_chains(spark):
    order = random.Random(1).sample(range(200), 200)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(149)] + [(order[160], order[161]), (order[161], order[160])], "a long, b long")
    got = {r["node"]: r["root"] for r in S.components(edges).collect()}
    least, pair = min(order[:150]), min(order[160:162])
    assert got == {x: least for x in order[:150] if x != least} | {max(order[160:162]): pair}


def test_rows_equal_brute_force(spark):
    base = odd_rows()
    words = base[5][1].split() * 4
    near = [(300 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :]), "en", "s0", 1) for k in range(0, len(words), 7)]
    rows = base + near + [(400 + k, " ".join(words), "en", "s0", 1) for k in range(30)]
    frame = with_clashes(spark.createDataFrame(rows, DOCS))
    got = S.near_duplicates(frame)
    want = brute_components([(r[0], brute_print(r[1])) for r in rows])
    assert table(got) == sorted((w[:3] for w in want), key=repr)
    kept = S.keep_one(frame)
    assert kept.columns == frame.columns
    groups = {name: least for _, _, least, name in want}  # two components may have the same id: rows can share one
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, groups.values()))


def test_no_rows_and_null_ids_alone(spark):
    assert S.near_duplicates(no_docs(spark)).count() == 0
    assert S.keep_one(no_docs(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d", None, None, None)] * 3, DOCS)
    assert [r["component_id"] for r in S.near_duplicates(nulls).collect()] == [None] * 3
    assert S.keep_one(nulls).count() == 1
    assert S.near_duplicates(odd_docs(spark, 5)).count() == 17
