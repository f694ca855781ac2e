"""The engine as one object: recovery, full scans, and single changes, over an index at rest."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas as S
from ..functions import codecs
from ..functions.hashing import Interrupted
from ..operators import cache, detect, events, index, ops
from ..sources import effector, filesystem
from ..sources.store import IndexStore

log = logging.getLogger("twinsift")


@dataclass(frozen=True)
class Options:
    roots: tuple[str, ...] = ()
    dry_run: bool = True
    algorithm: str = "sha256"
    exclude: tuple[str, ...] = ()
    #: "all" forgets what any scan has not refreshed; "roots" only paths below the scanned roots.
    scope: str = "all"
    #: A path below two roots counts once.
    distinct_paths: bool = False
    #: Whether groups are elected without a window (see detect.elect); None: where a content has more than `hot` entries.
    skewed: bool | None = None
    hot: int = 1_000_000
    #: Pairs that are checked and logged together before they are replaced: at most about so many are open after a crash.
    batch: int = 10_000
    #: Parts in which files are read: each is in the index before the next begins, so a stopped scan starts from there.
    rounds: int = 1


@dataclass
class Observers:
    """Callbacks of a scan, each called on the driver with one row as a dictionary, as rows come from the cluster.

    `on_progress` gets counts (seen, hits, misses) after every `every` decisions and at the end. Without callbacks no
    rows come to the driver.
    """

    on_decision: Callable[[dict], None] | None = None
    on_pair: Callable[[dict], None] | None = None
    on_result: Callable[[dict], None] | None = None
    on_progress: Callable[[dict], None] | None = None
    every: int = 1000


@dataclass
class Report:
    """What a scan found: decisions per path, entries, pairs, results and counters, as DataFrames."""

    decisions: DataFrame
    entries: DataFrame
    pairs: DataFrame
    results: DataFrame
    counters: dict[str, int] = field(default_factory=dict)


class Session:
    def __init__(self, spark: SparkSession, folder: str, options: Options = Options(), clock: Callable[[], float] = time.time, observers: Observers = Observers()) -> None:
        self.spark, self.options, self.clock, self.observers = spark, options, clock, observers
        self.store = IndexStore(spark, folder, options.algorithm)
        self.should_abort: Callable[[], bool] = lambda: False
        #: What the scan that runs, or ran last, has done: parts read and files stored in them, and all parts.
        self.progress: dict[str, int] = {}
        self._held: list[DataFrame] = []

    def _hold(self, rows: DataFrame) -> DataFrame:
        """Keeps rows in memory until the next scan or change."""
        self._held.append(rows.persist())
        return rows

    def _let_go(self) -> None:
        for rows in self._held:
            rows.unpersist()
        self._held = []

    def _tell(self, rows: DataFrame, callback: Callable[[dict], None] | None) -> None:
        if callback:
            for r in rows.toLocalIterator():
                callback(r.asDict())

    def _tell_decisions(self, decisions: DataFrame) -> None:
        o = self.observers
        if not o.on_decision and not o.on_progress:
            return
        seen = {"seen": 0, "hits": 0, "misses": 0}
        for r in decisions.select("path", "decision").toLocalIterator():
            seen["seen"] += 1
            seen["hits" if r["decision"] == S.HIT else "misses"] += 1
            if o.on_decision:
                o.on_decision(r.asDict())
            if o.on_progress and seen["seen"] % o.every == 0:
                o.on_progress(dict(seen))
        if o.on_progress and seen["seen"] % o.every:
            o.on_progress(dict(seen))

    def _ask(self) -> None:
        if self.should_abort():
            raise Interrupted("stopped")

    # recovery

    def recover(self) -> list[dict]:
        """Ends every operation that a crash left planned; their results."""
        open_ = [r.asDict() for r in ops.by_status(self.store.op_log, S.OP_PLANNED).toLocalIterator()]
        if not open_:
            return []
        seen = self.spark.createDataFrame([effector.facts(o) for o in open_], StructType(list(S.OP_EVENTS.fields)).add("canonical_exists", "boolean").add("duplicate_exists", "boolean").add("backup_exists", "boolean").add("same_inode", "boolean"))
        ended = [(r.asDict(), *effector.recover(r.asDict())) for r in ops.recovery(seen).orderBy("id").toLocalIterator()]
        self._log([op | {"seq": op["seq"] + 1, "status": state, "message": said} for op, _, state, said in ended])
        return [result for _, result, _, _ in ended]

    def _log(self, rows: list[dict]) -> None:
        """Adds states of operations to the log, durable when this returns."""
        if rows:
            names = S.OP_EVENTS.names
            self.store.append("op_log", self.spark.createDataFrame([tuple(r[c] for c in names) for r in rows], S.OP_EVENTS))

    # full scan

    def run_full_scan(self) -> Report:
        """Scans the roots, reads what the index cannot answer for, reports pairs and applies them unless dry.

        What was read is merged into the index before pairs are made, so a scan that is stopped later starts from it;
        the whole index is written once, at the end. It forgets paths that this scan has not refreshed, but not after a
        stop, nor when parts of a tree could not be read. The report's tables hold until the next scan or change.
        """
        o, now = self.options, int(self.clock())
        self._let_go()
        self.store.vacuum()
        self.progress = {"parts": 0, "stored": 0, "of": max(1, o.rounds)}
        scanned = self._hold(filesystem.scan(self.spark, list(o.roots), o.exclude))
        faults = scanned.where("error IS NOT NULL").count()
        files = detect.regular_files(scanned).drop("root", "is_regular", "error")
        if o.distinct_paths:
            files = files.dropDuplicates(["path"])
        self._ask()
        decisions = cache.decide(files, self.store.inodes)
        self._tell_decisions(decisions)
        for k in range(o.rounds if o.rounds > 1 else 0):
            self._read_part(decisions, k, now)
        _, entries = cache.index_entries(files, self.store.inodes, lambda lead: filesystem.digests(lead, o.algorithm), now)
        entries = self._hold(entries)  # read once: the merge, the pairs and the commit share it
        at_rest = index.entries(self.store.paths, self.store.inodes)
        self._merge(entries.join(at_rest, ["path", "device", "inode", "size", "mtime_ns", "digest"], "left_anti"))
        self._ask()
        skewed = detect.largest_group(entries) > o.hot if o.skewed is None else o.skewed
        pairs = self._hold(detect.in_order(detect.dupe_pairs(entries, o.dry_run, skewed)))
        self._tell(pairs, self.observers.on_pair)
        results = detect.dry_run_results(pairs) if o.dry_run else self._apply(pairs)
        self._tell(results, self.observers.on_result)
        self._ask()
        paths, inodes = index.upsert(self.store.paths, self.store.inodes, entries)
        if not faults:
            paths = index.retain(paths, now - 1, list(o.roots) if o.scope == "roots" else None)
            inodes = index.prune(paths, inodes)
        else:
            log.warning("%d entries could not be read; nothing is forgotten", faults)
        counted = cache.counters(decisions, pairs, results).first().asDict()
        self.store.commit(paths=paths, inodes=inodes)
        return Report(decisions, entries, pairs, results, counted)

    def _merge(self, found: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts entries into the index and takes paths out of it; what is written grows with them."""
        none = self.spark.createDataFrame([], "path string")
        new_paths, out, new_inodes, bare = index.changes(self.store.paths, self.store.inodes, found, none if gone is None else gone)
        self.store.merge(paths=(new_paths, out), inodes=(new_inodes, bare))

    def _read_part(self, decisions: DataFrame, k: int, now: int) -> None:
        """Reads one of `rounds` parts of the inodes that have no stored digest, and merges it."""
        self._ask()
        part = decisions.where(F.col("digest").isNull() & (F.pmod(F.xxhash64("device", "inode"), F.lit(self.options.rounds)) == k))
        fresh = filesystem.digests(cache.leaders(part), self.options.algorithm).where("digest IS NOT NULL")
        entries = cache.fan_out(part.drop("digest", "decision"), fresh).withColumn("last_seen", F.lit(now).cast("long")).persist()
        self._merge(entries)
        self.progress |= {"parts": k + 1, "stored": self.progress["stored"] + entries.count()}
        entries.unpersist()

    def _apply(self, pairs: DataFrame) -> DataFrame:
        """Replaces duplicates by links, in rounds: all of a round are checked, then logged as planned, then replaced.

        Checks and replacements run in the tasks and their outcomes are tables beside the index, so nothing is
        gathered on the driver.
        """
        run = uuid.uuid4().hex[:8]
        folder = self.store.scratch(f"apply-{run}")
        rounds = max(1, -(-pairs.count() // self.options.batch))
        done: list[DataFrame] = []

        def kept(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

        for k in range(rounds):
            self._ask()
            part = pairs.where(F.pmod(F.xxhash64("duplicate_path"), F.lit(rounds)) == k)
            looked = effector.looked_at(part, self.options.algorithm)
            checked = kept(ops.preflight(looked).withColumn("n", F.monotonically_increasing_id()), f"checked-{k}")
            first = (self.store.op_log.agg(F.max("id")).first()[0] or 0) + 1
            backup = codecs.backup_path(F.col("duplicate_path"), run, F.col("n") + first)
            todo = checked.where("status IS NULL")
            planned = ops.append_planned(todo, first, backup, int(self.clock()))
            self.store.append("op_log", planned)
            replaced = kept(effector.replaced(todo.withColumn("backup_path", backup)), f"replaced-{k}")
            self.store.append("op_log", ops.ended(planned, replaced))
            done += [ops.results(checked.where("status IS NOT NULL").withColumn("fault", F.lit(""))), ops.results(replaced)]
        return detect.in_order(detect.union_all(done).drop("op_status"))

    # single changes

    def handle_changes(self, changes: DataFrame) -> DataFrame:
        """Results of a batch of changes: (path, type), at most one row per path; type is Modified or Deleted.

        Modified paths that are regular files are looked up in the index by path, read if they must be, and
        stored; deleted ones go. Each changed file is then paired with the first other path of its content.
        """
        now = int(self.clock())
        self._let_go()
        self.store.vacuum()
        paths, inodes = self.store.paths, self.store.inodes
        modified = filesystem.metas(changes.where(F.col("type") == S.MODIFIED))
        before = paths.join(changes.select("path").distinct(), "path", "left_semi")  # only what the changed paths hold is looked up
        known = self._hold(cache.resolve_digest(modified, index.entries(before, inodes)))
        kept = known.where("digest IS NOT NULL").select("path", *S.META, "digest")
        new = known.where("digest IS NULL").select("path", *S.META)
        fresh = filesystem.digests(cache.leaders(new), self.options.algorithm).where("digest IS NOT NULL")
        entries = self._hold(kept.unionByName(cache.fan_out(new, fresh).select("path", *S.META, "digest")).withColumn("last_seen", F.lit(now).cast("long")))
        self._merge(entries, changes.where(F.col("type") == S.DELETED).select("path"))
        alike = self.store.inodes.join(entries.select("digest").distinct(), "digest", "left_semi")
        pairs = self._hold(events.pairs_of_changes(entries, index.entries(self.store.paths, alike)).distinct())  # two changed files may name each other
        self._ask()
        return detect.dry_run_results(pairs) if self.options.dry_run else self._apply(pairs)

    def handle_change(self, path: str) -> dict | None:
        """The result for one changed file; None if it is no regular file or has no equal."""
        rows = self.handle_changes(self.spark.createDataFrame([(path, S.MODIFIED)], "path string, type string")).take(1)
        return rows[0].asDict() if rows else None

    def handle_removed(self, path: str) -> None:
        self.handle_changes(self.spark.createDataFrame([(path, S.DELETED)], "path string, type string"))
