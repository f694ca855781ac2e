from __future__ import annotations

import os

import pytest

from twinsift.operators import events
from twinsift.plans.session import Options, Session
from twinsift.streaming import follow, source


def test_a_folded_stream_equals_the_folded_table(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(f"/p{rng.randrange(40)}", rng.choice(["Modified", "Deleted"]), i) for i in range(400)]
    schema = "path string, type string, seq long"
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = follow.fold_stream(stream, ("seq",), f"file://{tmp_path}/check")
    want = events.fold(spark.createDataFrame(rows, schema), "seq")
    assert sorted(map(tuple, state().select("path", "type", "seq").collect())) == sorted(map(tuple, want.collect()))
    again = lambda: follow.fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ("seq",), f"file://{tmp_path}/check")
    assert sorted(map(tuple, again()().select("path", "type", "seq").collect())) == sorted(map(tuple, want.collect()))  # a restart without news
    more = [("/p1", "Deleted", 1000), ("/new", "Modified", 1001)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = events.fold(spark.createDataFrame(rows + more, schema), "seq")
    assert sorted(map(tuple, again()().select("path", "type", "seq").collect())) == sorted(map(tuple, want.collect()))


def test_a_stream_without_events_has_an_empty_state(spark, tmp_path):
    schema = "path string, type string, seq long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    state = follow.fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ("seq",), f"file://{tmp_path}/check")()
    assert state.columns == ["path", "type", "seq"]
    assert state.count() == 0


def test_one_bad_event_does_not_stop_the_others(spark, tmp_path):
    rows = [(0, "/good", "Modified"), (1, "/bad", "Modified"), (2, "/also", "Deleted")]
    spark.createDataFrame(rows, "seq long, path string, type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    handled = []

    class Engine:
        def handle_changes(self, changes):
            paths = sorted(r["path"] for r in changes.collect())
            if "/bad" in paths:
                raise ValueError("no")
            handled.extend(paths)
            return changes

    stream = spark.readStream.schema("seq long, path string, type string").parquet(str(tmp_path / "in"))
    follow.follow(Engine(), stream, f"file://{tmp_path}/check", lambda r: None, once=True).awaitTermination()
    assert sorted(handled) == ["/also", "/good"]


def test_differences():
    assert source.differences({"a": [1], "b": [1]}, {"b": [2], "c": [1]}) == [("a", "DELETE", False, False), ("b", "CLOSE_WRITE", False, True), ("c", "CLOSE_WRITE", False, True)]


@pytest.mark.parametrize("poll", [False, True])
def test_changes_are_journalled_and_replayed(tmp_path, poll):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a").write_text("x")
    reader = source.ChangeReader([str(data)], str(tmp_path / "journal"), poll)
    start = reader.initialOffset()
    got, one = reader.read(start)
    assert [r[1:3] for r in got] == [(str(data / "a"), "CLOSE_WRITE")]
    (data / "new").mkdir()
    (data / "new" / "inside").write_text("y")
    (data / "a").unlink()
    got, two = reader.read(one)
    seen = {(os.path.basename(r[1]), r[2]) for r in got}
    assert {("inside", "CLOSE_WRITE"), ("a", "DELETE")} <= seen
    assert len(list(reader.readBetweenOffsets(start, two))) >= 3
    assert reader.read(two)[1] == two
    again = source.ChangeReader([str(data)], str(tmp_path / "journal"), poll)
    assert {(os.path.basename(r[1]), r[2]) for r in again.read(one)[0]} == seen
    if not poll:
        os.rename(data / "new", tmp_path / "away")  # a directory that leaves takes its files along
        got, three = reader.read(two)
        assert ("inside", "MOVED_FROM") in {(os.path.basename(r[1]), r[2]) for r in got}
        os.rename(tmp_path / "away", data / "back")
        got, four = reader.read(three)
        assert (str(data / "back" / "inside"), "CLOSE_WRITE") in {r[1:3] for r in got}
        (data / "back" / "inside").write_text("longer")
        assert (str(data / "back" / "inside"), "CLOSE_WRITE") in {r[1:3] for r in reader.read(four)[0]}


def test_dropped_events_lead_to_a_new_listing(tmp_path, monkeypatch):
    from twinsift.streaming import kernel

    data = tmp_path / "data"
    data.mkdir()
    (data / "a").write_text("x")
    reader = source.ChangeReader([str(data)], str(tmp_path / "journal"))
    _, one = reader.read({"k": 0})
    (data / "b").write_text("y")

    def dropped(self):
        raise kernel.Overflow

    monkeypatch.setattr(kernel.Watches, "read", dropped)
    got, _ = reader.read(one)
    assert (str(data / "b"), "CLOSE_WRITE") in {r[1:3] for r in got}


def test_the_index_follows_a_stream(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a").write_text("same")
    session = Session(spark, f"file://{tmp_path}/index", Options((str(data),)))
    seen: list[tuple] = []

    def run():
        stream = source.changes(spark, [str(data)], str(tmp_path / "journal"))
        follow.follow(session, stream, f"file://{tmp_path}/check", lambda r: seen.extend((x["canonical_path"], x["duplicate_path"]) for x in r.collect()), once=True).awaitTermination()

    run()
    assert seen == []
    (data / "b").write_text("same")
    run()
    assert seen == [(str(data / "a"), str(data / "b"))]
    (data / "a").unlink()
    run()
    assert [r["path"] for r in session.store.paths.collect()] == [str(data / "b")]
