from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pytest
from helpers import no_docs, odd_docs, table, with_clashes

from twinsift.llm import quality_crf as Q


def test_marginals_equal_sums_over_all_labellings():
    field = Q.LineField(0, 1, np.zeros(1), 0.0, np.array([[0.7, -0.3], [0.2, 0.5]]))
    u = [0.3, -1.2, 2.0, 0.1, -0.4]
    total, ones = 0.0, [0.0] * len(u)
    for labels in itertools.product((0, 1), repeat=len(u)):
        w = math.exp(sum(x for x, y in zip(u, labels, strict=True) if y) + sum(field.t[a, b] for a, b in itertools.pairwise(labels)))
        total += w
        for i, y in enumerate(labels):
            ones[i] += w * y
    assert np.allclose(field.marginals(u), [x / total for x in ones])


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    u, real = rng.normal(size=(3, 4)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    y, t = np.array([1, 0, 1]), rng.normal(size=(2, 2))

    def likelihood(u, t):
        out = 0.0
        for row, keep, label in zip(u, real, y, strict=True):
            n = int(keep.sum())
            score = lambda labels: sum(a for a, b in zip(row[:n], labels, strict=True) if b) + sum(t[a, b] for a, b in itertools.pairwise(labels))  # noqa: B023, E731
            z = math.log(sum(math.exp(score(x)) for x in itertools.product((0, 1), repeat=n)))
            out += (score([label] * n) - z) / n
        return out

    du, dt = Q._gradient(u, real, y, t)
    for i, j in [(0, 0), (0, 3), (1, 1), (2, 0)]:
        d = np.zeros_like(u)
        d[i, j] = 1e-6
        assert abs((likelihood(u + d, t) - likelihood(u - d, t)) / 2e-6 - du[i, j]) < 1e-5
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros_like(t)
        d[i, j] = 1e-6
        assert abs((likelihood(u, t + d) - likelihood(u, t - d)) / 2e-6 / 3 - dt[i, j]) < 1e-5


def test_features_do_not_depend_on_the_batch_or_the_blocks():
    texts = ["", "a a a b\nB! 12\n\na a a b", "ü %% x\n", "\n", "last line"]
    together, counts, _ = Q.line_features(texts)
    alone = np.concatenate([Q.line_features([t])[0] for t in texts])
    assert np.allclose(together, alone)
    assert np.allclose(together, Q.line_features(texts, limit=3)[0])
    assert counts.tolist() == [1, 4, 2, 2, 1]
    at = dict(zip(Q.NAMES, together.T, strict=True))
    assert at["repeated line"].tolist() == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert at["repeated word"][1] == 0.5


def test_held_out_accuracy(labelled_rows):
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 3 == 1
    model = Q.fit([(r[1], r[2]) for r in labelled_rows if not held(r)], epochs=20)
    test = [r for r in labelled_rows if held(r)]
    got = model.score([r[1] for r in test])["predicted"]
    assert np.mean([p == r[2] for p, r in zip(got, test, strict=True)]) > 0.97
    assert np.mean([p for p, r in zip(got, test, strict=True) if r[2] == 1]) > 0.99


def test_odd_rows(spark, docs, labels):
    model = Q.learn(docs, labels)
    rows = odd_docs(spark)
    got = Q.score_quality(with_clashes(rows), model)
    assert got.count() == rows.count()
    assert got.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> CAST(score >= 0.5 AS INT) OR held_out IS NULL").count() == 0
    assert table(got.select("doc_id", "held_out")) == sorted(((r["doc_id"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows.collect()), key=repr)
    assert len(set(map(tuple, got.where("doc_id IN (100, 101)").select("score").collect()))) == 1
    assert Q.keep_good(with_clashes(rows), model).columns == with_clashes(rows).columns
    assert Q.score_quality(no_docs(spark), model).count() == 0


def test_nothing_to_learn_from(spark, labels):
    model = Q.learn(no_docs(spark), labels.limit(0))
    assert model.score(["any text"])["predicted"] == [1]


def test_the_sample_has_no_held_out_rows(spark, docs, labels):
    from twinsift.llm.common import labelled

    text = {r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1} - {r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    rows = labelled(docs, labels, "quality", (5000, 5000), 1)
    assert rows
    assert not text & {t for t, _ in rows}
    assert rows == labelled(docs.repartition(3), labels.repartition(2), "quality", (5000, 5000), 1)


def test_the_query_equals_brute_force(spark, small, docs, labels):
    """Document scores from the sum over all label sequences of short documents, weighted by line lengths."""
    from itertools import product
    from math import exp

    from twinsift.llm.registry import QUERIES

    model = Q.learn(docs, labels)
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_crf"](spark, small).collect()}
    seen = 0
    for r in docs.collect():
        lines = (r["text"] or "").split("\n")
        if len(lines) > 9:
            continue
        f = [Q.line_features([r["text"] or ""])[0][i] for i in range(len(lines))]
        zero = np.zeros_like(f[0])
        u = [float((np.concatenate([x, f[i - 1] if i else zero, f[i + 1] if i + 1 < len(f) else zero]) - model.mean) / model.scale @ model.w + model.b) for i, x in enumerate(f)]
        z, good = 0.0, [0.0] * len(u)
        for y in product((0, 1), repeat=len(u)):
            p = exp(sum(min(30, max(-30, a)) * b for a, b in zip(u, y, strict=True)) + sum(model.t[a][b] for a, b in zip(y, y[1:], strict=False)))
            z += p
            for i, v in enumerate(y):
                good[i] += p * v
        weight = [max(1, len(x.encode())) for x in lines]
        score = sum(g / z * w for g, w in zip(good, weight, strict=True)) / sum(weight)
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)
        assert got[r["doc_id"]]["n_lines"] == len(lines)
        seen += 1
    assert seen > 50


def test_ids_that_repeat_do_not_crowd_others_out(spark):
    from twinsift.llm.common import least_ids

    rows = [(i, i % 2) for i in range(2000)] + [(5, 1)] * 30000 + [(8, 0)] * 10
    frame = spark.createDataFrame(rows, "doc_id long, v int")
    got = least_ids(frame, "doc_id", "v", {0: 100, 1: 300}, 3)
    assert [sum(v == k for _, v in got) for k in (0, 1)] == [100, 300]
    assert len(set(got)) == 400
    assert got == least_ids(frame.repartition(5), "doc_id", "v", {0: 100, 1: 300}, 3)
    assert len(least_ids(frame, "doc_id", "v", {0: 5000, 1: 5000}, 3)) == 2000
    assert least_ids(frame.limit(0), "doc_id", "v", {0: 5, 1: 5}, 3) == []
