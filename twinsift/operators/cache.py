"""Which digests of the index can be reused, and which files must be read.

Expensive digests stand on the miss side of a physical split only: a CASE would let a Python digest run for
hits as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FAILED, HIT, LINKED, MISS

VALIDITY = ("size", "mtime_ns", "inode", "device")
INODE = ("device", "inode")


def is_stale(stored: str, current: str) -> Column:
    """Whether size, mtime, inode or device differ between two aliases; mode and owner do not count."""
    same = F.lit(True)
    for c in VALIDITY:
        same = same & F.col(f"{current}.{c}").eqNullSafe(F.col(f"{stored}.{c}"))
    return ~same


def stale_entries(index: DataFrame, current: DataFrame) -> DataFrame:
    """Paths of the index whose file is still there with other metadata."""
    return index.alias("i").join(current.alias("c"), "path").where(is_stale("i", "c")).select("path")


def resolve_digest(changed: DataFrame, index: DataFrame) -> DataFrame:
    """Event path: each changed file with the digest stored for its path, if the metadata hold, else a miss.

    reason: hit, stale or no_entry. A renamed file is a miss here, though a scan, which looks inodes up, hits.
    """
    stored = index.select("path", *VALIDITY, "digest").alias("i")
    met = changed.alias("c").join(stored, F.col("c.path") == F.col("i.path"), "left")
    reason = F.when(F.col("i.path").isNull(), "no_entry").when(is_stale("i", "c"), "stale").otherwise("hit")
    return met.select(
        *(F.col(f"c.{c}").alias(c) for c in changed.columns if c != "digest"),
        F.when(reason == "hit", F.col("i.digest")).alias("digest"),
        reason.alias("reason"),
        F.when(reason == "hit", HIT).otherwise(MISS).alias("decision"),
    )


def leaders(files: DataFrame) -> DataFrame:
    """One path of each inode, the first in order: the one that is read for all its aliases."""
    w = Window.partitionBy(*INODE).orderBy("path")
    return files.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def decide(files: DataFrame, inodes: DataFrame) -> DataFrame:
    """Full scan: each path with its decision, looked up by inode; `digest` is the stored one where it holds.

    The first path of an inode whose stored row is missing or stale is a miss; its aliases are hits, since they
    take the digest that the first one gets.
    """
    stored = inodes.select(*VALIDITY, "digest").alias("i")
    own = files.withColumn("_k", F.row_number().over(Window.partitionBy(*INODE).orderBy("path"))).alias("c")
    met = own.join(stored, [F.col("c.device") == F.col("i.device"), F.col("c.inode") == F.col("i.inode")], "left")
    holds = F.col("i.inode").isNotNull() & ~is_stale("i", "c")
    return met.select(
        *(F.col(f"c.{c}").alias(c) for c in files.columns if c != "digest"),
        F.when(holds, F.col("i.digest")).alias("digest"),
        F.when(holds | (F.col("c._k") > 1), HIT).otherwise(MISS).alias("decision"),
    )


def fan_out(files: DataFrame, digests: DataFrame) -> DataFrame:
    """All aliases of an inode with the digest of its leader."""
    return files.join(digests.select(*INODE, "digest"), list(INODE))


def index_entries(files: DataFrame, inodes: DataFrame, hashed, now: int) -> tuple[DataFrame, DataFrame]:
    """(decisions, entries) of a scan. `hashed` maps the leaders of stale or new inodes to (device, inode, digest).

    Entries are all files with a digest, stored or new, and last_seen = now; a file that could not be read has none.
    """
    decided = decide(files, inodes)
    fresh = hashed(leaders(decided.where("digest IS NULL")))
    known = decided.where("digest IS NOT NULL").drop("decision")
    new = fan_out(decided.where("digest IS NULL").drop("digest", "decision"), fresh.where("digest IS NOT NULL"))
    return decided, known.unionByName(new).withColumn("last_seen", F.lit(now).cast("long"))


def counters(decisions: DataFrame, pairs: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """One row: scanned, hits, misses, dupes, linked, failed. Statuses other than Linked and Failed are not counted."""
    one = decisions.agg(F.count("*").alias("scanned"), F.count_if(F.col("decision") == HIT).alias("hits"), F.count_if(F.col("decision") == MISS).alias("misses"))
    two = pairs.agg(F.count("*").alias("dupes"))
    if results is None:
        three = one.sparkSession.range(1).select(F.lit(0).cast("long").alias("linked"), F.lit(0).cast("long").alias("failed"))
    else:
        three = results.agg(F.count_if(F.col("status") == LINKED).alias("linked"), F.count_if(F.col("status") == FAILED).alias("failed"))
    key = F.lit(1).alias("_one")  # single rows meet on a constant
    return one.withColumn("_one", key).join(two.withColumn("_one", key), "_one").join(three.withColumn("_one", key), "_one").drop("_one")
