from __future__ import annotations

import os

import pytest

from twinsift import cli, config, daemon
from twinsift import schemas as S
from twinsift.functions.hashing import Interrupted
from twinsift.plans.session import Options, Session
from twinsift.sources import effector, filesystem
from twinsift.sources.lock import LockFile
from twinsift.sources.store import IndexStore


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "data"
    (top / "sub").mkdir(parents=True)
    (top / "a").write_text("same")
    (top / "b").write_text("same")
    (top / "c").write_text("different")
    (top / "sub" / ".hidden").write_text("same")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "x").write_text("same")
    (top / "link").symlink_to(top / "a")
    (top / "linked").symlink_to(tmp_path / "outside")
    return top


def engine(spark, tmp_path, tree, clock=None, **options):
    return Session(spark, f"file://{tmp_path}/index", Options((str(tree),), **options), **({"clock": clock} if clock else {}))


def names(frame, column="duplicate_path"):
    return sorted(os.path.basename(r[column]) for r in frame.collect())


def test_the_scan_skips_links_and_lists_hidden_names(spark, tree):
    rows = filesystem.scan(spark, [str(tree)], partitions=2).collect()
    assert sorted(os.path.relpath(r["path"], tree) for r in rows) == ["a", "b", "c", "sub/.hidden"]
    twice = filesystem.scan(spark, [str(tree), str(tree / "sub")])
    assert twice.where("path LIKE '%hidden'").count() == 2
    assert filesystem.scan(spark, [str(tree)], exclude=(".hid*",)).count() == 3


def test_a_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        filesystem.scan(spark, [str(tmp_path / "none")]).count()


def test_dry_run_changes_nothing_and_a_second_scan_only_hits(spark, tmp_path, tree):
    s = engine(spark, tmp_path, tree)
    before = {p: os.stat(p).st_ino for p in (tree / "a", tree / "b")}
    one = s.run_full_scan()
    assert one.counters == {"scanned": 4, "hits": 0, "misses": 4, "dupes": 2, "linked": 0, "failed": 0}
    assert names(one.results) == [".hidden", "b"]
    assert {r["message"] for r in one.results.collect()} == {"dry-run"}
    assert s.run_full_scan().counters["hits"] == 4
    assert before == {p: os.stat(p).st_ino for p in before}


def test_apply_links_and_reports_it_later_as_linked(spark, tmp_path, tree):
    s = engine(spark, tmp_path, tree, dry_run=False, batch=1)
    one = s.run_full_scan()
    assert one.counters["linked"] == 2
    assert os.stat(tree / "a").st_ino == os.stat(tree / "b").st_ino
    assert (tree / "b").read_text() == "same"
    assert {r["status"] for r in s.run_full_scan().results.collect()} == {S.ALREADY_LINKED}
    assert s.store.op_log.where("status = 'done'").count() == 2


def test_a_stored_digest_is_trusted_while_metadata_hold(spark, tmp_path, tree):
    s = engine(spark, tmp_path, tree)
    s.run_full_scan()
    from pyspark.sql import functions as F

    s.store.commit(inodes=s.store.inodes.withColumn("digest", F.lit("77" * 32)))
    os.chmod(tree / "a", 0o755)
    (tree / "b").write_text("longer than before")
    got = {os.path.basename(r["path"]): r["digest"] for r in s.run_full_scan().entries.collect()}
    assert got["a"] == "77" * 32
    assert got["b"] != "77" * 32


def test_paths_that_a_scan_does_not_find_are_forgotten(spark, tmp_path, tree):
    now = [1000]
    s = engine(spark, tmp_path, tree, clock=lambda: now[0])
    s.run_full_scan()
    (tree / "c").unlink()
    now[0] = 1001
    s.run_full_scan()
    assert "c" in names(s.store.paths, "path")  # seen a second before: kept
    now[0] = 1002
    s.run_full_scan()
    assert names(s.store.paths, "path") == [".hidden", "a", "b"]
    assert s.store.inodes.count() == 3


def test_an_interrupted_scan_keeps_what_it_has_read_and_forgets_nothing(spark, tmp_path, tree):
    now = [1000]
    s = engine(spark, tmp_path, tree, clock=lambda: now[0])
    s.run_full_scan()
    (tree / "c").unlink()
    (tree / "d").write_text("new")
    now[0] = 5000
    asked = []
    s.should_abort = lambda: asked.append(1) or len(asked) > 1
    with pytest.raises(Interrupted):
        s.run_full_scan()
    assert names(s.store.paths, "path") == [".hidden", "a", "b", "c", "d"]


def test_what_was_read_in_parts_is_kept_when_the_scan_stops(spark, tmp_path, tree):
    for k in range(20):
        (tree / f"n{k}").write_text(f"content {k}")
    s = engine(spark, tmp_path, tree, rounds=3)
    asked = []
    s.should_abort = lambda: asked.append(1) or len(asked) > 2
    with pytest.raises(Interrupted):
        s.run_full_scan()
    kept = s.store.paths.count()
    assert 0 < kept < 24
    s.should_abort = lambda: False
    again = s.run_full_scan()
    assert again.counters["misses"] == 24 - kept
    assert again.counters["dupes"] == 2
    assert s.run_full_scan().counters["hits"] == 24


def test_single_changes(spark, tmp_path, tree):
    s = engine(spark, tmp_path, tree)
    assert s.handle_change(str(tree / "a")) is None
    got = s.handle_change(str(tree / "b"))
    assert (got["canonical_path"], got["duplicate_path"], got["message"]) == (str(tree / "a"), str(tree / "b"), "dry-run")
    s.handle_removed(str(tree / "a"))
    s.handle_removed("/unknown")
    assert names(s.store.paths, "path") == ["b"]
    assert s.handle_change(str(tree / "link")) is None
    assert s.store.paths.count() == 1


def pairs_of(spark, *rows):
    return spark.createDataFrame([(str(a), str(b), d, 4) for a, b, d in rows], "canonical_path string, duplicate_path string, digest string, size_bytes long")


def test_changes_between_scan_and_apply(spark, tree):
    from twinsift.functions.hashing import hash_file
    from twinsift.operators import ops

    d = hash_file(str(tree / "a"))
    pairs = pairs_of(spark, (tree / "c", tree / "b", d), (tree / "a", tree / "c", d), (tree / "a", tree / "link", d), (tree / "nothing", tree / "d", d), (tree / "a", tree / "b", d))
    checked = {(os.path.basename(r["canonical_path"]), os.path.basename(r["duplicate_path"])): r.asDict() for r in ops.preflight(effector.looked_at(pairs, "sha256")).collect()}
    assert checked["c", "b"]["message"] == S.SAYS_CANONICAL_CHANGED
    assert checked["a", "c"]["message"] == S.SAYS_DUPLICATE_CHANGED
    assert checked["a", "link"]["message"] == S.SAYS_SYMLINK
    assert checked["nothing", "d"]["status"] == S.FAILED
    go = checked["a", "b"]
    assert go["status"] is None
    (tree / "b").write_text("late")
    assert effector.replace(go | {"backup_path": str(tree / "tmp")}) == S.SAYS_DUPLICATE_CHANGED
    assert (tree / "b").read_text() == "late"


def test_a_replacement_that_runs_again_finds_its_link(tree):
    from twinsift.functions.hashing import hash_file

    pair = {"canonical_path": str(tree / "a"), "duplicate_path": str(tree / "b"), "digest": hash_file(str(tree / "a"))}
    op = pair | effector.look(pair, "sha256") | {"backup_path": str(tree / "b.tmp")}
    assert effector.replace(op) == ""
    (tree / "b.tmp").write_text("left by a lost task")
    assert effector.replace(op) == ""
    assert not (tree / "b.tmp").exists()
    assert os.stat(tree / "a").st_ino == os.stat(tree / "b").st_ino


def test_a_failed_link_restores_the_duplicate(spark, tree, monkeypatch):
    from twinsift.functions.hashing import hash_file
    from twinsift.operators import ops

    pair = {"canonical_path": str(tree / "a"), "duplicate_path": str(tree / "b"), "digest": hash_file(str(tree / "a"))}
    op = pair | effector.look(pair, "sha256") | {"backup_path": str(tree / "b.tmp")}
    monkeypatch.setattr(os, "link", lambda *_: (_ for _ in ()).throw(PermissionError(13, "no")))
    fault = effector.replace(op)
    got = ops.results(spark.createDataFrame([(str(tree / "a"), str(tree / "b"), "d", 4, None, "", fault)], "canonical_path string, duplicate_path string, digest string, size_bytes long, status string, message string, fault string")).first()
    assert (got["status"], got["op_status"], got["message"]) == (S.SKIPPED, "failed", S.SAYS_NOT_WRITABLE)
    assert (tree / "b").read_text() == "same"


def test_recovery_of_a_crash(spark, tmp_path, tree):
    s = engine(spark, tmp_path, tree)
    os.rename(tree / "b", tree / "b.tmp")
    os.link(tree / "a", tree / "d")
    (tree / "d.tmp").write_text("same")
    rows = [(1, str(tree / "b"), str(tree / "b.tmp")), (2, str(tree / "d"), str(tree / "d.tmp")), (3, str(tree / "c"), "")]
    s._log([{"id": i, "seq": 0, "canonical": str(tree / "a"), "duplicate": d, "backup_path": b, "status": "planned", "message": "", "created_at": 1} for i, d, b in rows])
    assert [(r["status"], r["message"]) for r in s.recover()] == [(S.FAILED, S.SAYS_RESTORED), (S.LINKED, ""), (S.FAILED, S.SAYS_UNRECOVERABLE)]
    assert (tree / "b").read_text() == "same"
    assert not (tree / "d.tmp").exists()
    assert s.recover() == []


def test_the_store_swaps_whole_tables(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/s")
    assert store.paths.count() == 0
    rows = spark.createDataFrame([("/a", 1, 1, 5)], "path string, device long, inode long, last_seen long")
    store.commit(paths=rows)
    old = store.paths
    store.commit(paths=old.unionByName(old))
    assert (old.count(), store.paths.count()) == (1, 2)
    store.vacuum()
    assert store.paths.count() == 2
    with pytest.raises(ValueError, match="never mixed"):
        IndexStore(spark, f"file://{tmp_path}/s", "blake3")


def test_merges_write_what_changes(spark, tmp_path):
    import twinsift.sources.store as st

    store = IndexStore(spark, f"file://{tmp_path}/s")
    schema = "path string, device long, inode long, last_seen long"
    none = spark.createDataFrame([], "path string")
    store.commit(paths=spark.createDataFrame([(f"/{k}", 1, k, 5) for k in range(100)], schema))
    store.merge(paths=(spark.createDataFrame([("/3", 1, 3, 9), ("/new", 1, 200, 9)], schema), spark.createDataFrame([("/4",), ("/none",)], "path string")))
    store.merge(paths=(spark.createDataFrame([("/4", 1, 4, 11)], schema), spark.createDataFrame([("/5",)], "path string")))
    want = sorted([(f"/{k}", 1, k, 5) for k in range(100) if k not in (3, 4, 5)] + [("/3", 1, 3, 9), ("/new", 1, 200, 9), ("/4", 1, 4, 11)])
    assert sorted(map(tuple, store.paths.collect())) == want
    for k in range(st.MERGE):
        store.merge(paths=(spark.createDataFrame([("/3", 1, 3, 20 + k)], schema), none))
    assert len(store._pointer()["tables"]["paths"]) <= 2
    assert store.paths.where("path = '/3'").first()["last_seen"] == 19 + st.MERGE
    assert store.paths.count() == len(want)


def test_changes_of_the_index_equal_upsert_and_remove(spark):
    import random

    from twinsift.operators import index

    rng = random.Random(3)
    entry = lambda p, i, d: (p, 1, 2, i, 1, 0, 0, 0, d, rng.randrange(9))
    schema = "path string, size long, mtime_ns long, inode long, device long, mode long, uid long, gid long, digest string, last_seen long"
    before = spark.createDataFrame([entry(f"/{k}", k // 2, f"d{k // 2}") for k in range(30)], schema)
    found = spark.createDataFrame([entry(f"/{k}", 50 + k % 3, f"n{k % 3}") for k in range(4, 12)], schema)
    gone = spark.createDataFrame([(f"/{k}",) for k in (0, 1, 2, 4, 29, 77)], "path string")
    paths, inodes = index.split(before)
    want = index.upsert(*index.remove(paths, inodes, gone), found)
    new_paths, out, new_inodes, bare = index.changes(paths, inodes, found, gone)
    got_paths = paths.join(out.unionByName(new_paths.select("path")), "path", "left_anti").unionByName(new_paths)
    got_inodes = inodes.join(bare.unionByName(new_inodes.select("device", "inode")), ["device", "inode"], "left_anti").unionByName(new_inodes)
    rows = lambda f, c: sorted(map(tuple, f.select(*c).collect()))
    assert rows(got_paths, index.PATH_COLUMNS) == rows(want[0], index.PATH_COLUMNS)
    assert rows(got_inodes, index.INODE_COLUMNS) == rows(want[1], index.INODE_COLUMNS)


def test_observers_see_decisions_pairs_results_and_progress(spark, tmp_path, tree):
    from twinsift.plans.session import Observers

    s, seen = engine(spark, tmp_path, tree), {"decision": [], "pair": [], "result": [], "progress": []}
    s.observers = Observers(*(seen[k].append for k in seen), every=3)
    s.run_full_scan()
    assert [len(seen[k]) for k in seen] == [4, 2, 2, 2]
    assert seen["progress"] == [{"seen": 3, "hits": 0, "misses": 3}, {"seen": 4, "hits": 0, "misses": 4}]
    assert [os.path.basename(r["duplicate_path"]) for r in seen["pair"]] == ["b", ".hidden"]


def test_deep_trees_and_large_flat_folders(spark, tmp_path):
    deep = tmp_path / "deep"
    deep.mkdir()
    os.chdir(deep)
    for _ in range(1200):  # by steps: the whole path is longer than a call takes
        os.mkdir("d")
        os.chdir("d")
    os.chdir(tmp_path)
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(250):
        (flat / f"f{k}").touch()
    reader = filesystem.TreeReader([str(flat)], (), 8, share=100)
    parts = reader.partitions()
    assert len(parts) == 3
    assert sorted(r[1] for p in parts for r in reader.read(p)) == sorted(str(flat / f"f{k}") for k in range(250))
    assert sum(1 for _ in filesystem.walk(str(deep), str(deep))) <= 1


def test_one_instance(tmp_path):
    path = str(tmp_path / "lock")
    with LockFile(path), pytest.raises(RuntimeError, match="already held"):
        LockFile(path)
    (tmp_path / "lock").touch()  # what a crash leaves does no harm
    LockFile(path).release()
    assert not os.path.exists(path)


def test_command_line(spark, tmp_path, tree):
    assert cli.run(str(tmp_path / "db"), [str(tree)], "DEBUG", False, spark) == 0
    assert cli.run(str(tmp_path / "db"), [str(tree)], "loud", False, spark) == 1
    assert cli.run(str(tmp_path / "db"), [str(tmp_path / "none")], "", False, spark) == 1
    (tmp_path / "file").touch()
    assert cli.run(str(tmp_path / "file"), [str(tree)], "", False, spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["--db", "x"])


def test_daemon_follows_changes(spark, tmp_path, tree):
    (tmp_path / "config").mkdir()
    run = lambda apply=True: daemon.run(str(tmp_path / "config"), [str(tree)], "", apply, spark, once=True)
    assert run() == 0
    assert os.stat(tree / "a").st_ino == os.stat(tree / "b").st_ino
    with LockFile(str(tmp_path / "config" / "twinsift.lock")):
        assert run() == 1
    assert daemon.run(str(tmp_path / "none"), [str(tree)], "", False, spark, once=True) == 1
    assert daemon.run(str(tmp_path / "config"), [], "", False, spark, once=True) == 1


def test_arguments_from_the_environment():
    env = {"TWINSIFT_CONFIG": "/config", "TWINSIFT_DATA": " /data, ,/another "}
    assert config.arguments(env | {"LOG_LEVEL": "info"}) == ["--config", "/config", "--apply", "--log-level", "info", "/data", "/another"]
    assert config.arguments(env | {"TWINSIFT_MODE": "dry-run"}) == ["--config", "/config", "/data", "/another"]
    for bad in ({}, env | {"TWINSIFT_MODE": "banana"}, env | {"TWINSIFT_DATA": " , "}):
        with pytest.raises(ValueError):
            config.arguments(bad)
