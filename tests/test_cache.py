from __future__ import annotations

import pytest

from twinsift.operators import cache

META = "path string, size long, mtime_ns long, inode long, device long, mode long, uid long, gid long"
BASE = {"path": "/f", "size": 100, "mtime_ns": 1000, "inode": 10, "device": 1, "mode": 0o644, "uid": 1000, "gid": 1000}


def meta(spark, *rows, extra=""):
    names = [c.split()[0] for c in (META + extra).split(", ")]
    return spark.createDataFrame([tuple((BASE | r)[n] for n in names) for r in rows], META + extra)


@pytest.mark.parametrize(("change", "stale"), [({}, False), ({"size": 101}, True), ({"mtime_ns": 1001}, True), ({"inode": 11}, True), ({"device": 2}, True), ({"mode": 0o600}, False), ({"uid": 0}, False), ({"gid": 0}, False)])
def test_staleness(spark, change, stale):
    found = cache.stale_entries(meta(spark, {}), meta(spark, change))
    assert found.count() == int(stale)


def test_event_lookup_is_by_path(spark):
    index = meta(spark, {"digest": "d1"}, extra=", digest string")
    seen = cache.resolve_digest(meta(spark, {}, {"path": "/renamed"}), index)
    assert {(r["path"], r["digest"], r["reason"], r["decision"]) for r in seen.collect()} == {("/f", "d1", "hit", "Hit"), ("/renamed", None, "no_entry", "Miss")}
    stale = cache.resolve_digest(meta(spark, {"mtime_ns": 5}), index).first()
    assert (stale["digest"], stale["reason"]) == (None, "stale")


def test_scan_lookup_is_by_inode_and_reads_one_alias(spark):
    inodes = spark.createDataFrame([(100, 1000, 10, 1, "forged")], "size long, mtime_ns long, inode long, device long, digest string")
    files = meta(spark, {"path": "/moved"}, {"path": "/new/a", "inode": 11}, {"path": "/new/b", "inode": 11}, {"path": "/grown", "inode": 12})
    got = {r["path"]: (r["digest"], r["decision"]) for r in cache.decide(files, inodes).collect()}
    assert got == {"/moved": ("forged", "Hit"), "/new/a": (None, "Miss"), "/new/b": (None, "Hit"), "/grown": (None, "Miss")}
    read = []

    def hashed(lead):
        read.extend(sorted(r["path"] for r in lead.collect()))
        return lead.selectExpr("device", "inode", "concat('h', inode) AS digest")

    _, entries = cache.index_entries(files, inodes, hashed, 7)
    assert read == ["/grown", "/new/a"]
    assert {(r["path"], r["digest"], r["last_seen"]) for r in entries.collect()} == {("/moved", "forged", 7), ("/new/a", "h11", 7), ("/new/b", "h11", 7), ("/grown", "h12", 7)}


def test_counters_count_linked_and_failed_only(spark):
    d = spark.createDataFrame([("Hit",), ("Miss",), ("Miss",)], "decision string")
    p = spark.range(4)
    r = spark.createDataFrame([("Linked",), ("Failed",), ("Skipped",), ("AlreadyLinked",)], "status string")
    assert cache.counters(d, p, r).first().asDict() == {"scanned": 3, "hits": 1, "misses": 2, "dupes": 4, "linked": 1, "failed": 1}
