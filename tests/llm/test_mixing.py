from __future__ import annotations

import duckdb
import pytest
from helpers import DOCS, no_docs, odd_docs, odd_rows, table, with_clashes

from twinsift.llm import mixing


def sql_rows(rows: list[tuple]) -> list[tuple]:
    import pandas as pd
    import pyarrow as pa

    con = duckdb.connect()
    documents = pa.table({c.split()[0]: pa.array([r[i] for r in rows], pa.int64() if "long" in c else pa.string()) for i, c in enumerate(DOCS.split(", "))})
    con.register("documents", documents)
    got = con.sql(mixing.SQL)
    assert pd is not None
    names = ["doc_id", "size", "source_size", "target", "taken"]
    places = [got.columns.index(c) for c in names]
    return sorted((tuple(r[i] for i in places) for r in got.fetchall()), key=repr)


def test_amounts_equal_their_sql(spark):
    rows = odd_rows() + [(i, "w " * (i % 7 * 9), None, "s9", None) for i in range(500, 620)] + [(7, "same words here", "en", "s3", 1)] * 40 + [(None, "x y", None, "s3", 1)] * 30
    got = mixing.mix_amounts(with_clashes(spark.createDataFrame(rows, DOCS)))
    assert table(got.select("doc_id", "size", "source_size", "target", "taken")) == sql_rows(rows)


def test_targets_are_shared_stop_at_three_times_and_are_met(spark):
    sizes = {"a": 10, "b": 5000, "c": 300, "d": 7000, None: 40}
    rows = [(i, "w " * 5, None, s, None) for s, n in sizes.items() for i in range(n // 5)]
    got = mixing.mix_amounts(spark.createDataFrame(rows, DOCS)).groupBy("source_size", "target").sum("taken").collect()
    total = sum(sizes.values())
    by = {r["source_size"]: r for r in got}
    assert abs(sum(r["target"] for r in got) - total) < 1e-6
    # weights in order of name, null last: a 1, b 2, c 3, d 1, null 2
    assert by[10]["target"] == 30
    assert by[300]["target"] == 900
    assert by[40]["target"] == 120
    rest = total - 30 - 900 - 120
    assert by[5000]["target"] == pytest.approx(rest * 2 / 3)
    assert by[7000]["target"] == pytest.approx(rest / 3)
    assert all(abs(r["sum(taken)"] - r["target"]) < 2 * mixing.BLOCK for r in got)
    assert sum(abs(r["sum(taken)"] - r["target"]) < mixing.BLOCK for r in got) >= 4


GOAL = "source string, s long, take long"


def test_the_schedule_keeps_every_prefix_near_its_weights(spark):
    goal = spark.createDataFrame([("a", 1, 600), ("b", 2, 300), ("c", 3, 100)], GOAL)
    slots = [r["s"] for r in mixing.schedule(goal, 987).orderBy("slot").collect()]
    assert len(slots) == 987
    for n in (10, 50, 137, 500, 987):
        for s, share in ((1, 0.6), (2, 0.3), (3, 0.1)):
            assert abs(slots[:n].count(s) - share * n) <= 3
    ranks = mixing.schedule(goal, 89).where("s = 2").orderBy("slot")
    assert [r["rank"] for r in ranks.collect()] == list(range(ranks.count()))


def test_the_schedule_equals_a_plain_loop(spark, monkeypatch):
    takes = [700, 10, 0, 4321, 55, 1]
    goal = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(takes, 1)], GOAL)
    total, n, upto, want = sum(takes), 610, [0], []
    for t in takes:
        upto.append(upto[-1] + t)
    edges = [u * mixing.RANGE // total for u in upto]
    ranks = [0] * len(takes)
    for k in range(n):
        point = k * mixing.GOLDEN % mixing.RANGE
        s = next(i for i in range(len(takes)) if edges[i] <= point < edges[i + 1])
        want.append((k, s + 1, ranks[s]))
        ranks[s] += 1
    for run in (mixing.SLOT_RUN, 64):  # ranks do not depend on the runs they are counted in
        monkeypatch.setattr(mixing, "SLOT_RUN", run)
        assert sorted(map(tuple, mixing.schedule(goal, n).select("slot", "s", "rank").collect())) == want


def test_slots_follow_the_words():
    assert [mixing.slots_for(w, 10) for w in (0, 1, 10, 11, 100, 1000)] == [0, 1, 1, 2, 13, 144]


def test_counts_at_fibonacci_numbers_are_within_two():
    for n in (13, 233, 4181):
        points = sorted(k * mixing.GOLDEN % mixing.RANGE / mixing.RANGE for k in range(n))
        for low, high in ((0.0, 0.1), (0.123, 0.456), (0.5, 0.99), (0.3, 0.3001)):
            assert abs(sum(low <= x < high for x in points) - n * (high - low)) < 2


def test_the_sequence_decides_what_is_taken(spark):
    rows = [(i, "w " * (i % 11 + 1), None, f"s{i % 7}", None) for i in range(600)]
    frame = spark.createDataFrame(rows, DOCS)
    per = lambda golden: [r[1] for r in sorted(map(tuple, mixing.mix(frame, block=8, golden=golden)[1].groupBy("s").sum("taken").collect()))]
    golden, clumped = per(mixing.GOLDEN), per(mixing.RANGE // 1000)
    assert golden != clumped
    goal = [r[1] for r in sorted(map(tuple, mixing.mix(frame, block=8)[1].groupBy("s").agg({"target": "max"}).collect()))]
    assert max(abs(a - b) for a, b in zip(golden, goal, strict=True)) < 16 < max(abs(a - b) for a, b in zip(clumped, goal, strict=True))
    fewer = [r[1] for r in sorted(map(tuple, mixing.mix(frame, block=40)[1].groupBy("s").sum("taken").collect()))]
    assert fewer != golden


def test_blocks_of_all_sources_are_equal_and_cover_what_is_taken(spark):
    rows = [(i, "w " * (i % 11 + 1), None, f"s{i % 3}", None) for i in range(200)]
    blocks, amounts = mixing.mix(spark.createDataFrame(rows, DOCS), block=20)
    sizes = [r["sum(words)"] for r in blocks.groupBy("s", "rank").sum("words").collect()]
    assert max(sizes) - min(sizes) <= 1
    assert len(sizes) == blocks.select("slot").distinct().count() == mixing.slots_for(sum(i % 11 + 1 for i in range(200)), 20)
    assert blocks.agg({"words": "sum"}).first()[0] == amounts.agg({"taken": "sum"}).first()[0]


def test_reruns_and_partitions_do_not_matter(spark):
    frame = spark.createDataFrame(odd_rows(), DOCS)
    assert table(mixing.mix_amounts(frame)) == table(mixing.mix_amounts(frame.repartition(7)))


def test_documents_come_as_often_as_they_are_taken(spark):
    rows = [(i, "w " * 10, None, "big" if i < 90 else "small", i) for i in range(100)]
    got = mixing.mixed(with_clashes(spark.createDataFrame(rows, DOCS)))
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3
    assert 30 - sum(counts.get(i, 0) for i in range(90, 100)) <= 6  # two blocks
    assert abs(sum(counts.get(i, 0) for i in range(90)) - 70) <= 6  # two blocks
    assert got.columns == with_clashes(spark.createDataFrame(rows, DOCS)).columns


def test_no_rows_and_no_words(spark):
    assert mixing.mix_amounts(no_docs(spark)).count() == 0
    empty = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], DOCS)
    assert table(mixing.mix_amounts(empty).select("doc_id", "size", "target", "taken")) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(odd_docs(spark, 5)).count() > 0


def test_rows_alike_share_whole_copies(spark):
    """Rows without an id and of one size: all of a source lie on its cut."""
    rows = [(None, f"w{i} " * 10, None, "a", i) for i in range(70)] + [(None, f"v{i} " * 10, None, "b", i) for i in range(30)] + [(None, "x y " * 5, None, "c", 5)] * 50
    frame = spark.createDataFrame(rows, DOCS)
    goal = {r["source_size"]: r["target"] for r in mixing.mix_amounts(frame).collect()}
    copies = mixing.mixed(frame).groupBy("source", "text").count().collect()
    for source, size in (("a", 700), ("b", 300), ("c", 500)):
        assert abs(10 * sum(r["count"] for r in copies if r["source"] == source) - goal[size]) <= 10 + 2 * mixing.BLOCK
    for source, n in (("a", 70), ("b", 30)):
        counts = [r["count"] for r in copies if r["source"] == source]
        counts += [0] * (n - len(counts))
        assert max(counts) - min(counts) <= 1
