"""One query per operator, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import cache, detect, events, index, ops
from ..sources.shared import folder
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# scans and scalar functions


@query("scan_regular_files", f"WITH {X.FILES} SELECT path, size FROM files WHERE source <> 'src19' AND path NOT LIKE '/data/src18/es/%'")
def _(spark, d):
    # one source stands for directories, part of another one for files that could not be read
    scanned = X.files(spark, d).withColumns({"is_regular": F.col("source") != "src19", "error": F.when(F.col("path").like("/data/src18/es/%"), "EACCES")})
    return detect.regular_files(scanned).select("path", "size")


@query("multi_root_union", f"WITH {X.FILES} SELECT path, size FROM files UNION ALL SELECT path, size FROM files WHERE path LIKE '/data/src0/%'")
def _(spark, d):
    # the root /data and, inside it, /data/src0: what both hold is listed twice
    all_ = X.files(spark, d)
    return detect.union_all([all_, all_.where(F.col("path").startswith("/data/src0/"))]).select("path", "size")


@query("file_meta", f"WITH {X.FILES} SELECT path, size, mtime_ns, inode, device, mode, uid, gid FROM files")
def _(spark, d):
    return X.files(spark, d).select("path", "size", "mtime_ns", "inode", "device", "mode", "uid", "gid")


@query("content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", codecs.sha256_hex(F.col("text")).alias("digest"))


@query("digest_hex", "SELECT doc_id, md5(text) AS hexed, lower(hex(encode(lang))) AS lang_hex FROM documents")
def _(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", codecs.digest_hex(F.unhex(F.md5(F.col("text").cast("binary")))).alias("hexed"), codecs.digest_hex(F.col("lang").cast("binary")).alias("lang_hex"))


@query("parse_roots", r"""
SELECT page_id, list_filter(list_transform(string_split(url || ' , ,' || chr(9) || '/b ' || ',', ','), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS roots FROM pages""")
def _(spark, d):
    raw = F.concat("url", F.lit(" , ,\t/b ,"))
    return X.table(spark, d, "pages").select("page_id", codecs.parse_roots(raw).alias("roots"))


# detection


@query("size_candidates", f"WITH {X.FILES} SELECT path, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)")
def _(spark, d):
    return detect.size_candidates(X.files(spark, d)).select("path", "size")


@query("dupe_groups", f"WITH {X.FILES} SELECT size, digest, min(path) AS canonical_path, count(*) AS n FROM files GROUP BY size, digest HAVING count(*) > 1")
def _(spark, d):
    return detect.dupe_groups(X.files(spark, d))


@query("canonical_file", f"WITH {X.FILES} SELECT min(path) AS path, size, digest, count(*) AS n FROM files GROUP BY size, digest HAVING count(*) > 1")
def _(spark, d):
    return detect.canonical_files(X.files(spark, d))


@query("dupe_pairs", f"WITH {X.PAIRS} SELECT canonical_path, duplicate_path, digest, size_bytes FROM pairs")
def _(spark, d):
    return detect.dupe_pairs(X.files(spark, d))


@query("dupe_pairs_skewed", f"WITH {X.PAIRS} SELECT canonical_path, duplicate_path, digest, size_bytes FROM pairs")
def _(spark, d):
    return detect.dupe_pairs(X.files(spark, d), skewed=True)


_DRY = f"""WITH {X.PAIRS}, fresh AS (
  SELECT p.* FROM pairs p JOIN files c ON c.path = p.canonical_path JOIN files f ON f.path = p.duplicate_path WHERE NOT (c.device = f.device AND c.inode = f.inode)
)"""


@query("dupe_pairs_dry_run", f"{_DRY} SELECT canonical_path, duplicate_path, digest, size_bytes FROM fresh")
def _(spark, d):
    return detect.dupe_pairs(X.files(spark, d), dry_run=True)


@query("dry_run_results", f"{_DRY} SELECT canonical_path, duplicate_path, digest, size_bytes, 'Skipped' AS status, 'dry-run' AS message FROM fresh")
def _(spark, d):
    return detect.dry_run_results(detect.dupe_pairs(X.files(spark, d), dry_run=True))


@query("results_in_order", f"""{_DRY} SELECT row_number() OVER (ORDER BY size_bytes, digest, duplicate_path) - 1 AS place, canonical_path, duplicate_path, digest, size_bytes FROM fresh""")
def _(spark, d):
    return detect.placed(detect.in_order(detect.dupe_pairs(X.files(spark, d), dry_run=True)))


@query("distinct_inodes", f"WITH {X.FILES} SELECT DISTINCT device, inode FROM files")
def _(spark, d):
    return detect.distinct_inodes(X.files(spark, d))


@query("ext_savings", f"{_DRY} SELECT count(*) AS pairs, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM fresh")
def _(spark, d):
    return detect.savings(detect.dupe_pairs(X.files(spark, d), dry_run=True))


# reuse of digests

_CHANGED = "(i.size <> f.size OR i.mtime_ns <> f.mtime_ns OR i.inode <> f.inode OR i.device <> f.device)"


@query("stale_entries", f"WITH {X.KNOWN} SELECT f.path FROM idx i JOIN files f ON f.path = i.path WHERE {_CHANGED}")
def _(spark, d):
    return cache.stale_entries(X.known(spark, d), X.files(spark, d))


@query("resolve_digest", f"""WITH {X.KNOWN}, met AS (
  SELECT f.path, i.digest, CASE WHEN i.path IS NULL THEN 'no_entry' WHEN {_CHANGED} THEN 'stale' ELSE 'hit' END AS reason FROM files f LEFT JOIN idx i ON i.path = f.path
) SELECT path, CASE WHEN reason = 'hit' THEN digest END AS digest, reason, CASE WHEN reason = 'hit' THEN 'Hit' ELSE 'Miss' END AS decision FROM met""")
def _(spark, d):
    return cache.resolve_digest(X.files(spark, d), X.known(spark, d)).select("path", "digest", "reason", "decision")


_DECIDED = f"""WITH {X.KNOWN}, met AS (
  SELECT f.*, i.digest AS stored, i.inode IS NOT NULL AND NOT coalesce({_CHANGED}, true) AS holds, row_number() OVER (PARTITION BY f.device, f.inode ORDER BY f.path) AS k
  FROM files f LEFT JOIN inodes i ON i.device = f.device AND i.inode = f.inode
), decided AS (
  SELECT path, CASE WHEN holds THEN stored END AS digest, CASE WHEN holds OR k > 1 THEN 'Hit' ELSE 'Miss' END AS decision FROM met
)"""


@query("scan_cache_decision", f"{_DECIDED} SELECT path, digest, decision FROM decided")
def _(spark, d):
    _, inodes = X.stored(spark, d)
    return cache.decide(X.files(spark, d), inodes).select("path", "digest", "decision")


@query("inode_leader", f"WITH {X.FILES} SELECT min(path) AS path, device, inode FROM files GROUP BY device, inode")
def _(spark, d):
    return cache.leaders(X.files(spark, d)).select("path", "device", "inode")


@query("alias_fanout", f"WITH {X.FILES} SELECT path, device, inode, digest FROM files")
def _(spark, d):
    all_ = X.files(spark, d)
    return cache.fan_out(all_.drop("digest"), cache.leaders(all_)).select("path", "device", "inode", "digest")


@query("cached_and_hashed", f"""{_DECIDED} SELECT f.path, f.device, f.inode, f.size, CASE WHEN m.holds THEN m.stored ELSE f.digest END AS digest, CAST({X.NOW} AS BIGINT) AS last_seen
FROM files f JOIN met m ON m.path = f.path""")
def _(spark, d):
    # what the index cannot answer for is hashed again, one path of each inode; both parts together are the scan's entries
    all_ = X.files(spark, d)
    _, inodes = X.stored(spark, d)
    contents = all_.select("path", F.col("digest").alias("digest"))
    _, entries = cache.index_entries(all_.drop("digest"), inodes, lambda lead: lead.select("path", "device", "inode").join(contents, "path").drop("path"), X.NOW)
    return entries.select("path", "device", "inode", "size", "digest", "last_seen")


@query("scan_counters", f"""{_DECIDED}, elected AS (
  SELECT *, min(path) OVER (PARTITION BY size, digest) AS canonical_path FROM files
), dry AS (
  SELECT e.path FROM elected e JOIN files c ON c.path = e.canonical_path WHERE e.path <> e.canonical_path AND NOT (c.device = e.device AND c.inode = e.inode)
) SELECT count(*) AS scanned, count(*) FILTER (decision = 'Hit') AS hits, count(*) FILTER (decision = 'Miss') AS misses,
         (SELECT count(*) FROM dry) AS dupes, CAST(0 AS BIGINT) AS linked, CAST(0 AS BIGINT) AS failed FROM decided""")
def _(spark, d):
    all_ = X.files(spark, d)
    _, inodes = X.stored(spark, d)
    pairs = detect.dupe_pairs(all_, dry_run=True)
    return cache.counters(cache.decide(all_, inodes), pairs, detect.dry_run_results(pairs))


# the index

_ENTRIES = f"WITH {X.KNOWN}, entries AS (SELECT p.path, i.size, i.mtime_ns, i.inode, i.device, i.mode, i.uid, i.gid, i.digest, p.last_seen FROM paths p JOIN inodes i USING (device, inode))"


@query("index_entries", f"{_ENTRIES} SELECT * FROM entries")
def _(spark, d):
    return index.entries(*X.stored(spark, d))


@query("index_upsert", f"""WITH {X.KNOWN} SELECT path, size, mtime_ns, inode, device, mode, uid, gid, digest, CAST({X.NOW} AS BIGINT) AS last_seen FROM files""")
def _(spark, d):
    # the scan found every file, so it replaces what was known
    found = X.files(spark, d).withColumn("last_seen", F.lit(X.NOW).cast("long"))
    return index.entries(*index.upsert(*X.stored(spark, d), found))


@query("index_upsert_part", f"""WITH {X.KNOWN}, found AS (SELECT * FROM files WHERE source = 'src2'), all_paths AS (
  SELECT path, device, inode, last_seen FROM paths WHERE path NOT IN (SELECT path FROM found) UNION ALL SELECT path, device, inode, {X.NOW} FROM found
), all_inodes AS (
  SELECT * FROM inodes i WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.device = i.device AND f.inode = i.inode)
  UNION ALL SELECT device, inode, min(size), min(mtime_ns), min(mode), min(uid), min(gid), min(digest), {X.NOW} FROM found GROUP BY device, inode
) SELECT p.path, i.size, i.mtime_ns, i.inode, i.device, i.mode, i.uid, i.gid, i.digest, CAST(p.last_seen AS BIGINT) AS last_seen FROM all_paths p JOIN all_inodes i USING (device, inode)""")
def _(spark, d):
    # the scan of one root: known inodes, stale ones and new ones among it
    found = X.files(spark, d).where("source = 'src2'").withColumn("last_seen", F.lit(X.NOW).cast("long"))
    return index.entries(*index.upsert(*X.stored(spark, d), found))


@query("find_by_path", f"{_ENTRIES} SELECT * FROM entries WHERE path = (SELECT min(path) FROM entries)")
def _(spark, d):
    all_ = index.entries(*X.stored(spark, d))
    return index.find_by_path(all_, all_.agg(F.min("path")).first()[0])


@query("find_by_inode", f"""WITH {X.KNOWN} SELECT i.*, coalesce(p.path, '') AS path FROM inodes i LEFT JOIN (SELECT device, inode, min(path) AS path FROM paths GROUP BY ALL) p USING (device, inode)""")
def _(spark, d):
    return index.first_paths(*X.stored(spark, d))


@query("find_by_digest", f"""{_ENTRIES} SELECT * FROM entries WHERE digest = (SELECT digest FROM entries GROUP BY digest ORDER BY count(*) DESC, digest LIMIT 1)""")
def _(spark, d):
    all_ = index.entries(*X.stored(spark, d))
    most = all_.groupBy("digest").count().orderBy(F.desc("count"), "digest").first()
    return index.find_by_digest(all_, most[0] if most else "")


@query("retention_keep", f"WITH {X.KNOWN} SELECT path, device, inode, last_seen FROM paths WHERE last_seen >= 500")
def _(spark, d):
    return index.retain(X.stored(spark, d)[0], 500)


@query("orphan_inodes", f"WITH {X.KNOWN} SELECT device, inode, digest FROM inodes i WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.last_seen >= 500 AND p.device = i.device AND p.inode = i.inode)")
def _(spark, d):
    paths, inodes = X.stored(spark, d)
    return index.orphans(index.retain(paths, 500), inodes).select("device", "inode", "digest")


@query("prune_cascade", f"WITH {X.KNOWN} SELECT device, inode, digest FROM inodes i WHERE EXISTS (SELECT 1 FROM paths p WHERE p.last_seen >= 500 AND p.device = i.device AND p.inode = i.inode)")
def _(spark, d):
    # paths go by retention, and with them the inodes that only they held
    paths, inodes = X.stored(spark, d)
    return index.prune(index.retain(paths, 500), inodes).select("device", "inode", "digest")


@query("index_changes", f"""{_ENTRIES}, found AS (SELECT * FROM files WHERE source = 'src2'), gone AS (SELECT path FROM paths WHERE path LIKE '/data/src3/%'), touched AS (
  SELECT path FROM found UNION SELECT path FROM gone
), left_ AS (SELECT DISTINCT device, inode FROM paths WHERE path IN (SELECT path FROM touched) EXCEPT SELECT device, inode FROM found)
SELECT 'path' AS what, path, device, inode, true AS stays FROM found UNION ALL SELECT 'path', path, NULL, NULL, false FROM gone
UNION ALL SELECT DISTINCT 'inode', NULL, device, inode, true FROM found
UNION ALL SELECT 'inode', NULL, device, inode, false FROM left_ l WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.device = l.device AND p.inode = l.inode AND p.path NOT IN (SELECT path FROM touched))""")
def _(spark, d):
    # one source was scanned again, another one is removed: what the index has to write
    paths, inodes = X.stored(spark, d)
    found = X.files(spark, d).where("source = 'src2'").withColumn("last_seen", F.lit(X.NOW).cast("long"))
    gone = paths.where(F.col("path").startswith("/data/src3/")).select("path")
    new_paths, out, new_inodes, bare = index.changes(paths, inodes, found, gone)
    none, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    parts = [
        new_paths.select(F.lit("path").alias("what"), "path", "device", "inode", F.lit(True).alias("stays")),
        out.select(F.lit("path").alias("what"), "path", number.alias("device"), number.alias("inode"), F.lit(False).alias("stays")),
        new_inodes.select(F.lit("inode").alias("what"), none.alias("path"), "device", "inode", F.lit(True).alias("stays")),
        bare.select(F.lit("inode").alias("what"), none.alias("path"), "device", "inode", F.lit(False).alias("stays")),
    ]
    return detect.union_all(parts)


@query("remove_by_path", f"""WITH {X.KNOWN}, left_ AS (SELECT * FROM paths WHERE path NOT LIKE '/data/src2/%')
SELECT p.path, i.size, i.mtime_ns, i.inode, i.device, i.mode, i.uid, i.gid, i.digest, p.last_seen FROM left_ p JOIN inodes i USING (device, inode)""")
def _(spark, d):
    paths, inodes = X.stored(spark, d)
    gone = paths.where(F.col("path").startswith("/data/src2/")).select("path")
    return index.entries(*index.remove(paths, inodes, gone))


# events


@query("event_classify", f"""WITH {X.FS_EVENTS}, seen AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'CLOSE_WRITE' WHEN 'error' THEN 'DELETE' WHEN 'purchase' THEN 'MOVED_TO' WHEN 'view' THEN 'CREATE' ELSE 'DELETE_SELF' END AS kind,
         event_id % 3 = 0 AS is_dir, event_id % 2 = 0 AS is_regular FROM fs_events
) SELECT event_id, CASE WHEN kind = 'DELETE_SELF' THEN 'Unsubscribe' WHEN is_dir AND kind IN ('CREATE', 'MOVED_TO') THEN 'Subscribe'
     WHEN NOT is_dir AND kind IN ('CLOSE_WRITE', 'MOVED_TO') AND is_regular THEN 'Modified' WHEN NOT is_dir AND kind = 'DELETE' THEN 'Deleted' END AS means FROM seen""")
def _(spark, d):
    rows = X.fs_events(spark, d)
    t = F.col("event_type")
    kind = F.when(t == "click", "CLOSE_WRITE").when(t == "error", "DELETE").when(t == "purchase", "MOVED_TO").when(t == "view", "CREATE").otherwise("DELETE_SELF")
    return rows.select("event_id", events.classify(kind, F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0).alias("means"))


_LIVE = f"WITH {X.FS_EVENTS}, last_ AS (SELECT * FROM fs_events QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1)"


@query("event_fold_state", f"{_LIVE} SELECT path, event_id FROM last_ WHERE type = 'Modified'")
def _(spark, d):
    return events.live(X.fs_events(spark, d), "ts", "event_id").select("path", "event_id")


_AFTER = f"""WITH {X.KNOWN}, after AS (SELECT path, digest FROM files)"""


@query("change_matches", f"""{_AFTER} SELECT f.path, f.digest, f.size, min(a.path) AS other_path, count(*) AS others FROM files f JOIN after a ON a.digest = f.digest AND a.path <> f.path
  WHERE f.path NOT IN (SELECT path FROM idx) GROUP BY ALL""")
def _(spark, d):
    # files that the index does not know arrive; they are matched against the index after their upsert
    all_ = X.files(spark, d)
    changed = all_.join(X.known(spark, d).select("path"), "path", "left_anti")
    return events.matches(changed, all_)


@query("change_pair", f"""{_AFTER}, met AS (
  SELECT f.path, f.digest, f.size, min(a.path) AS other FROM files f JOIN after a ON a.digest = f.digest AND a.path <> f.path GROUP BY ALL
) SELECT least(path, other) AS canonical_path, greatest(path, other) AS duplicate_path, digest, size AS size_bytes FROM met""")
def _(spark, d):
    all_ = X.files(spark, d)
    return events.pairs_of_changes(all_, all_)


# operations


@query("op_status_decode", f"WITH {X.OP_LOG} SELECT id, seq, CASE WHEN status IN ('done', 'failed') THEN status ELSE 'planned' END AS status FROM op_log")
def _(spark, d):
    return X.op_log(spark, d).select("id", "seq", codecs.op_status(F.col("status")).alias("status"))


@query("op_log_current", f"WITH {X.OP_LOG} SELECT * FROM op_now")
def _(spark, d):
    return ops.current(X.op_log(spark, d))


@query("op_log_by_status", f"WITH {X.OP_LOG} SELECT * FROM op_now WHERE status = 'planned'")
def _(spark, d):
    return ops.by_status(X.op_log(spark, d), "planned")


@query("op_log_append", f"""WITH {X.PAIRS} SELECT n + 1 AS id, CAST(0 AS BIGINT) AS seq, canonical_path AS canonical, duplicate_path AS duplicate,
  duplicate_path || '.dd_tmp.r1.' || CAST(n AS VARCHAR) AS backup_path, 'planned' AS status, '' AS message, CAST({X.NOW} AS BIGINT) AS created_at FROM pairs""")
def _(spark, d):
    return ops.append_planned(X.pairs(spark, d), 1, codecs.backup_path(F.col("duplicate_path"), "r1", F.col("n")), X.NOW)


@query("preflight_status", f"WITH {X.CHECKED} SELECT duplicate_path, status, message FROM flown")
def _(spark, d):
    return ops.preflight(X.checked(spark, d)).select("duplicate_path", "status", "message")


@query("apply_results", f"WITH {X.CHECKED} SELECT * FROM applied")
def _(spark, d):
    return ops.results(ops.preflight(X.checked(spark, d)))


@query("unwritable_once", f"WITH {X.CHECKED} SELECT DISTINCT duplicate_path FROM applied WHERE message = 'duplicate path not writable, skipped'")
def _(spark, d):
    seen = ops.results(ops.preflight(X.checked(spark, d)))
    return events.unwritable_once(seen.unionByName(seen))


@query("recovery_decision", f"""WITH {X.OP_LOG}, open_ AS (
  SELECT id, id % 2 = 0 AS canonical_exists, id % 3 = 2 AND id % 4 < 2 AS duplicate_exists, id % 5 < 3 AS backup_exists, id % 8 < 4 AS same_inode FROM op_now WHERE status = 'planned'
) SELECT id, CASE WHEN canonical_exists AND duplicate_exists AND same_inode THEN CASE WHEN backup_exists THEN 'drop_backup' ELSE 'none' END
                  WHEN backup_exists AND NOT duplicate_exists THEN 'restore' ELSE 'none' END AS action,
  CASE WHEN canonical_exists AND duplicate_exists AND same_inode THEN 'Linked' ELSE 'Failed' END AS result,
  CASE WHEN canonical_exists AND duplicate_exists AND same_inode THEN 'done' ELSE 'failed' END AS op_status,
  CASE WHEN canonical_exists AND duplicate_exists AND same_inode THEN '' WHEN backup_exists AND NOT duplicate_exists THEN 'recovered original after interrupted apply'
       ELSE 'interrupted apply could not be automatically recovered' END AS result_message FROM open_""")
def _(spark, d):
    n = F.col("id")
    open_ = ops.by_status(X.op_log(spark, d), "planned").withColumns({"canonical_exists": n % 2 == 0, "duplicate_exists": (n % 3 == 2) & (n % 4 < 2), "backup_exists": n % 5 < 3, "same_inode": n % 8 < 4})
    return ops.recovery(open_).select("id", "action", "result", "op_status", "result_message")


# sources, streams and side effects


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder for real files: in the shared folder if that is a mounted one, else on the one machine that these small trees need."""
    place = folder(spark, name)
    if place.startswith(("file:", "/")):
        place = "/" + place.removeprefix("file:").lstrip("/")
        os.makedirs(place)
        return place
    return tempfile.mkdtemp(prefix="twinsift-")


@query("scan_files", """WITH made AS (
  SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'deep/er/' ELSE '' END || 'r' || n_regionkey || '/' AS place, CASE WHEN n_nationkey % 5 = 0 THEN '.' ELSE '' END || n_name AS name,
         n_nationkey AS k, CAST(length(n_name) AS BIGINT) AS size FROM nation
) SELECT place || name AS path, true AS is_regular, size FROM made UNION ALL SELECT place || name || ' too', true, size FROM made WHERE k % 6 = 1""")
def _(spark, d):
    from ..sources import filesystem

    # each nation is a file in its region's folder, some nested, some hidden, some with a second name, some with a symbolic link that a scan must not list
    top = f"{local_folder(spark, 'scan')}/data"
    for r in X.table(spark, d, "nation").toLocalIterator():
        k, name = r["n_nationkey"], r["n_name"]
        place = f"{top}/{'deep/er/' if k % 3 == 0 else ''}r{r['n_regionkey']}"
        os.makedirs(place, exist_ok=True)
        file = f"{place}/{'.' if k % 5 == 0 else ''}{name}"
        with open(file, "w") as f:
            f.write(name)
        if k % 6 == 1:
            os.link(file, f"{file} too")
        if k % 4 == 0:
            os.symlink(file, f"{file} link")
            os.symlink(top, f"{place}/back {k}")
    return filesystem.scan(spark, [top]).select(F.substring("path", len(os.path.realpath(top)) + 2, 1 << 20).alias("path"), "is_regular", "size")


@query("stream_fold_state", f"{_LIVE} SELECT path, event_id FROM last_ WHERE type = 'Modified'")
def _(spark, d):
    from ..streaming.follow import fold_stream

    raw = spark.readStream.schema(X.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    state = fold_stream(X.as_fs_events(raw).select("path", "type", "ts", "event_id"), ("ts", "event_id"), folder(spark, "fold"))
    return state().where("type = 'Modified'").select("path", "event_id")


@query("apply_files", """SELECT first_ AS canonical, n_name AS duplicate, 'Linked' AS status
FROM (SELECT n_name, min(n_name) OVER (PARTITION BY n_regionkey) AS first_ FROM nation) WHERE n_name <> first_""")
def _(spark, d):
    from .session import Options, Session

    # each nation is a file whose content is its region
    top = local_folder(spark, "apply")
    os.makedirs(f"{top}/data")
    for r in X.table(spark, d, "nation").toLocalIterator():
        with open(f"{top}/data/{r['n_name']}", "w") as f:
            f.write(f"region {r['n_regionkey']}")
    found = Session(spark, f"file://{top}/index", Options((f"{top}/data",), dry_run=False)).run_full_scan()
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return found.results.select(name("canonical_path").alias("canonical"), name("duplicate_path").alias("duplicate"), "status")
