"""Driver tables seen as files, a prior index, events and operations; the same definitions in SQL.

documents are files: aliases share an inode among equal texts of even ids. The prior index knows most of them,
with some stale rows. events are file-system events. Operations derive from the duplicate pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import DigestFn, sha256_hex, size_bytes
from ..operators import detect

BORN = 1704067200000000000
NOW = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, digest: DigestFn = sha256_hex) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select(
        "doc_id", "source", F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"),
        size_bytes(F.col("text")).alias("size"), digest(F.col("text")).alias("digest"),
    )
    inode = F.when(F.col("doc_id") % 2 == 0, F.min("doc_id").over(Window.partitionBy("digest"))).otherwise(F.col("doc_id"))
    whole = held.withColumn("inode", inode)
    constant = {c: F.lit(v).cast("long") for c, v in (("device", 0), ("mode", 420), ("uid", 1000), ("gid", 1000))}
    return whole.withColumns({"mtime_ns": F.lit(BORN).cast("long") + F.col("inode") * 1000000000, **constant})


FILES = f"""held AS (
  SELECT doc_id, source, '/data/' || source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path,
         CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS digest
  FROM documents
), files AS (
  SELECT *, CASE WHEN doc_id % 2 = 0 THEN min(doc_id) OVER (PARTITION BY digest) ELSE doc_id END AS inode,
         {BORN} + (CASE WHEN doc_id % 2 = 0 THEN min(doc_id) OVER (PARTITION BY digest) ELSE doc_id END) * 1000000000 AS mtime_ns,
         CAST(0 AS BIGINT) AS device, CAST(420 AS BIGINT) AS mode, CAST(1000 AS BIGINT) AS uid, CAST(1000 AS BIGINT) AS gid
  FROM held
)"""


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the prior index."""
    rows = files(spark, sf_dir).where("doc_id % 5 <> 0")
    return rows.withColumns({"mtime_ns": F.when(F.col("inode") % 7 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")), "last_seen": F.when(F.col("doc_id") % 11 == 0, 100).otherwise(1000).cast("long")})


KNOWN = (
    FILES
    + """, idx AS (
  SELECT * REPLACE (CASE WHEN inode % 7 = 0 THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns),
         CAST(CASE WHEN doc_id % 11 = 0 THEN 100 ELSE 1000 END AS BIGINT) AS last_seen
  FROM files WHERE doc_id % 5 <> 0
), paths AS (
  SELECT path, device, inode, last_seen FROM idx
), inodes AS (
  SELECT device, inode, min(size) AS size, min(mtime_ns) AS mtime_ns, min(mode) AS mode, min(uid) AS uid, min(gid) AS gid,
         min(digest) AS digest, max(last_seen) AS last_seen
  FROM idx GROUP BY device, inode
)"""
)


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paths, inodes) of the prior index."""
    from ..operators import index

    return index.split(known(spark, sf_dir))


def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_fs_events(table(spark, sf_dir, "events"))


def as_fs_events(rows: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/data/u"), F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k"))
    return rows.select("event_id", "ts", path.alias("path"), F.when(F.col("event_type") == "error", "Deleted").otherwise("Modified").alias("type"), "event_type", "value")


FS_EVENTS = """fs_events AS (
  SELECT event_id, ts, '/data/u' || CAST(user_id AS VARCHAR) || '/' || json_extract_string(props, '$.k') AS path,
         CASE WHEN event_type = 'error' THEN 'Deleted' ELSE 'Modified' END AS type, event_type, value
  FROM events
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, with n, the id of the duplicate's document."""
    return detect.dupe_pairs(files(spark, sf_dir)).withColumn("n", F.substring("duplicate_path", -12, 12).cast("long"))


PAIRS = (
    FILES
    + """, elected AS (
  SELECT *, min(path) OVER (PARTITION BY size, digest) AS canonical_path, count(*) OVER (PARTITION BY size, digest) AS members FROM files
), pairs AS (
  SELECT canonical_path, path AS duplicate_path, digest, size AS size_bytes, doc_id AS n
  FROM elected WHERE members > 1 AND path <> canonical_path
)"""
)


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of operations: planned, then done or failed for two of three; some planned texts are unknown words."""
    own = pairs(spark, sf_dir).select(F.col("n").alias("id"), F.col("canonical_path").alias("canonical"), F.col("duplicate_path").alias("duplicate"), F.concat("duplicate_path", F.lit(".dd_tmp.0."), F.col("n").cast("string")).alias("backup_path"))
    first = own.select("id", F.lit(0).cast("long").alias("seq"), "canonical", "duplicate", "backup_path", F.when(F.col("id") % 5 == 0, "resting").otherwise("planned").alias("status"), F.lit("").alias("message"))
    then = own.where("id % 3 <> 2").select("id", F.lit(1).cast("long").alias("seq"), "canonical", "duplicate", "backup_path", F.when(F.col("id") % 3 == 0, "done").otherwise("failed").alias("status"), F.when(F.col("id") % 3 == 0, "").otherwise("link").alias("message"))
    return first.unionByName(then)


OP_LOG = (
    PAIRS
    + """, op_log AS (
  SELECT n AS id, CAST(0 AS BIGINT) AS seq, canonical_path AS canonical, duplicate_path AS duplicate, duplicate_path || '.dd_tmp.0.' || CAST(n AS VARCHAR) AS backup_path,
         CASE WHEN n % 5 = 0 THEN 'resting' ELSE 'planned' END AS status, '' AS message
  FROM pairs
  UNION ALL
  SELECT n, 1, canonical_path, duplicate_path, duplicate_path || '.dd_tmp.0.' || CAST(n AS VARCHAR),
         CASE WHEN n % 3 = 0 THEN 'done' ELSE 'failed' END, CASE WHEN n % 3 = 0 THEN '' ELSE 'link' END
  FROM pairs WHERE n % 3 <> 2
), op_now AS (
  SELECT id, seq, canonical, duplicate, backup_path, CASE WHEN status IN ('done', 'failed') THEN status ELSE 'planned' END AS status, message
  FROM op_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1
)"""
)


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with what is true of both files at the time of an apply."""
    own = files(spark, sf_dir).select("path", "device", "inode")
    c, d = own.alias("c"), own.alias("d")
    met = pairs(spark, sf_dir).join(c, F.col("canonical_path") == F.col("c.path")).join(d, F.col("duplicate_path") == F.col("d.path"))
    n = F.col("n")
    return met.select(
        "canonical_path", "duplicate_path", "digest", "size_bytes", "n",
        (n % 11 == 0).alias("canonical_symlink"), F.lit(False).alias("duplicate_symlink"), F.col("c.device").alias("canonical_device"),
        F.when(n % 7 == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("duplicate_device"), F.col("c.inode").alias("canonical_inode"), F.col("d.inode").alias("duplicate_inode"),
        F.when(n % 5 == 0, "changed").otherwise(F.col("digest")).alias("canonical_now"), F.when(n % 3 == 0, "changed").otherwise(F.col("digest")).alias("duplicate_now"),
        F.when(n % 4 == 0, "EACCES").when(n % 4 == 2, "link").otherwise("").alias("fault"),
    )


CHECKED = (
    PAIRS
    + """, checked AS (
  SELECT p.*, n % 11 = 0 AS canonical_symlink, c.device AS canonical_device, CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS duplicate_device,
         c.inode AS canonical_inode, d.inode AS duplicate_inode,
         CASE WHEN n % 5 = 0 THEN 'changed' ELSE p.digest END AS canonical_now, CASE WHEN n % 3 = 0 THEN 'changed' ELSE p.digest END AS duplicate_now,
         CASE WHEN n % 4 = 0 THEN 'EACCES' WHEN n % 4 = 2 THEN 'link' ELSE '' END AS fault
  FROM pairs p JOIN files c ON c.path = p.canonical_path JOIN files d ON d.path = p.duplicate_path
), flown AS (
  SELECT *,
         CASE WHEN canonical_symlink THEN 'Skipped' WHEN canonical_device <> duplicate_device THEN 'Skipped' WHEN canonical_inode = duplicate_inode THEN 'AlreadyLinked'
              WHEN canonical_now <> digest THEN 'Skipped' WHEN duplicate_now <> digest THEN 'Skipped' END AS status,
         CASE WHEN canonical_symlink THEN 'symlink detected, skipped' WHEN canonical_device <> duplicate_device THEN 'cross-device, cannot hardlink'
              WHEN canonical_inode = duplicate_inode THEN '' WHEN canonical_now <> digest THEN 'canonical file changed between scan and apply, skipped'
              WHEN duplicate_now <> digest THEN 'file changed between scan and apply, skipped' ELSE '' END AS message
  FROM checked
), applied AS (
  SELECT canonical_path, duplicate_path, digest, size_bytes,
         CASE WHEN status IS NOT NULL THEN status WHEN fault = '' THEN 'Linked' WHEN fault = 'EACCES' THEN 'Skipped' ELSE 'Failed' END AS status,
         CASE WHEN status IS NOT NULL THEN message WHEN fault = '' THEN '' WHEN fault = 'EACCES' THEN 'duplicate path not writable, skipped' ELSE fault END AS message,
         CASE WHEN status IS NULL THEN CASE WHEN fault = '' THEN 'done' ELSE 'failed' END END AS op_status
  FROM flown
)"""
)
