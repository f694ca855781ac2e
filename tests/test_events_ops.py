from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinsift import schemas as S
from twinsift.operators import events, ops


@pytest.mark.parametrize(
    ("kind", "is_dir", "regular", "means"),
    [("CLOSE_WRITE", False, True, "Modified"), ("MOVED_TO", False, True, "Modified"), ("CLOSE_WRITE", False, False, None), ("DELETE", False, False, "Deleted"), ("MOVED_FROM", False, False, "Deleted"), ("CREATE", False, True, None), ("CREATE", True, False, "Subscribe"), ("MOVED_TO", True, False, "Subscribe"), ("DELETE_SELF", True, False, "Unsubscribe"), ("MOVE_SELF", True, False, "Unsubscribe"), ("DELETE", True, False, None)],
)
def test_meaning_of_events(spark, kind, is_dir, regular, means):
    row = spark.range(1).select(events.classify(F.lit(kind), F.lit(is_dir), F.lit(regular)).alias("m")).first()
    assert row["m"] == means


def test_the_last_event_decides(spark):
    rows = [("/a", "Modified", 1), ("/a", "Deleted", 2), ("/b", "Deleted", 1), ("/b", "Modified", 3), ("/c", "Deleted", 9)]
    live = events.live(spark.createDataFrame(rows, "path string, type string, seq long"), "seq")
    assert [r["path"] for r in live.collect()] == ["/b"]


def test_a_change_is_paired_with_the_first_other_path(spark):
    index = spark.createDataFrame([("/a", "x"), ("/b", "x"), ("/c", "x"), ("/lone", "y")], "path string, digest string")
    changed = spark.createDataFrame([("/a", "x", 4), ("/c", "x", 4), ("/lone", "y", 1)], "path string, digest string, size long")
    got = {(r["canonical_path"], r["duplicate_path"]) for r in events.pairs_of_changes(changed, index).collect()}
    assert got == {("/a", "/b"), ("/a", "/c")}
    assert sorted((r["path"], r["other_path"], r["others"]) for r in events.matches(changed, index).collect()) == [("/a", "/b", 2), ("/c", "/a", 2)]


PAIR = {"canonical_path": "/c", "duplicate_path": "/d", "digest": "x", "size_bytes": 1, "canonical_symlink": False, "duplicate_symlink": False, "canonical_device": 1, "duplicate_device": 1, "canonical_inode": 1, "duplicate_inode": 2, "canonical_now": "x", "duplicate_now": "x"}


@pytest.mark.parametrize(
    ("facts", "status", "message"),
    [
        ({}, None, ""),
        ({"duplicate_symlink": True, "duplicate_device": 9}, S.SKIPPED, S.SAYS_SYMLINK),
        ({"duplicate_device": 2, "duplicate_inode": 1}, S.SKIPPED, S.SAYS_CROSS_DEVICE),
        ({"duplicate_inode": 1, "canonical_now": "y"}, S.ALREADY_LINKED, ""),
        ({"canonical_now": "y", "duplicate_now": "z"}, S.SKIPPED, S.SAYS_CANONICAL_CHANGED),
        ({"duplicate_now": "z"}, S.SKIPPED, S.SAYS_DUPLICATE_CHANGED),
    ],
)
def test_preflight_goes_by_the_first_check(spark, facts, status, message):
    row = ops.preflight(spark.createDataFrame([PAIR | facts])).first()
    assert (row["status"], row["message"]) == (status, message)


@pytest.mark.parametrize(("fault", "status", "message", "op"), [("", "Linked", "", "done"), ("EPERM", "Skipped", S.SAYS_NOT_WRITABLE, "failed"), ("link", "Failed", "link", "failed")])
def test_results(spark, fault, status, message, op):
    row = ops.results(ops.preflight(spark.createDataFrame([PAIR])).withColumn("fault", F.lit(fault))).first()
    assert (row["status"], row["message"], row["op_status"]) == (status, message, op)


@pytest.mark.parametrize(
    ("canonical", "duplicate", "backup", "same", "action", "result", "op", "message"),
    [
        (True, True, False, False, "none", "Failed", "failed", S.SAYS_UNRECOVERABLE),
        (True, False, True, False, "restore", "Failed", "failed", S.SAYS_RESTORED),
        (True, True, True, True, "drop_backup", "Linked", "done", ""),
        (True, True, False, True, "none", "Linked", "done", ""),
        (False, True, False, False, "none", "Failed", "failed", S.SAYS_UNRECOVERABLE),
        (False, False, True, False, "restore", "Failed", "failed", S.SAYS_RESTORED),
    ],
)
def test_recovery(spark, canonical, duplicate, backup, same, action, result, op, message):
    row = spark.createDataFrame([(1, "/b" if backup else "", canonical, duplicate, backup, same)], "id long, backup_path string, canonical_exists boolean, duplicate_exists boolean, backup_exists boolean, same_inode boolean")
    got = ops.recovery(row).first()
    assert (got["action"], got["result"], got["op_status"], got["result_message"]) == (action, result, op, message)


def test_the_last_state_of_an_operation_counts(spark):
    log = spark.createDataFrame([(1, 0, "planned"), (1, 1, "done"), (2, 0, "who knows"), (3, 0, "planned"), (3, 1, "done"), (3, 2, "failed")], "id long, seq long, status string")
    assert {(r["id"], r["status"]) for r in ops.current(log).collect()} == {(1, "done"), (2, "planned"), (3, "failed")}
    assert [r["id"] for r in ops.by_status(log, "planned").collect()] == [2]


def test_unwritable_paths_once(spark):
    rows = [("/d", "Skipped", S.SAYS_NOT_WRITABLE)] * 2 + [("/e", "Skipped", "dry-run")]
    got = events.unwritable_once(spark.createDataFrame(rows, "duplicate_path string, status string, message string"))
    assert [r[0] for r in got.collect()] == ["/d"]
