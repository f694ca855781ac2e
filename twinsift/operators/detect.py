"""Exact duplicates: entries of equal (size, digest), one canonical path each, and the pairs that point to it.

Entries have at least path, size, digest, device and inode.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DUPE_PAIR, SAYS_DRY_RUN, SKIPPED

GROUP = ("size", "digest")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; a path that two roots hold is listed twice."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def regular_files(scanned: DataFrame) -> DataFrame:
    """Regular files of a scan without those that could not be read."""
    return scanned.where("is_regular AND error IS NULL")


def size_candidates(entries: DataFrame) -> DataFrame:
    """Entries whose size another entry has too: the only ones that can have duplicates."""
    shared = entries.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    return entries.join(shared, "size", "left_semi")


def dupe_groups(entries: DataFrame) -> DataFrame:
    """One row per content that several entries have: size, digest, canonical_path, n."""
    return entries.groupBy(*GROUP).agg(F.min("path").alias("canonical_path"), F.count("*").alias("n")).where("n > 1")


def elect(entries: DataFrame, skewed: bool = False) -> DataFrame:
    """Each entry of a group of two or more with the group's canonical (the least path, in byte order) and its size.

    The default is one window over (size, digest): one exchange. A window holds a group in one task, so a content
    that a large share of all entries has (empty files, say) needs `skewed`: partial minima, and a join back whose
    hot keys Spark can split.
    """
    least = F.min(F.struct("path", "device", "inode")).alias("canonical")
    if skewed:
        groups = entries.groupBy(*GROUP).agg(least, F.count("*").alias("n")).where("n > 1")
        held = entries.join(groups, list(GROUP))
    else:
        w = Window.partitionBy(*GROUP)
        held = entries.select("*", F.min(F.struct("path", "device", "inode")).over(w).alias("canonical"), F.count("*").over(w).alias("n")).where("n > 1")
    return held.select(*entries.columns, F.col("canonical.path").alias("canonical_path"), F.col("canonical.device").alias("canonical_device"), F.col("canonical.inode").alias("canonical_inode"), "n")


def largest_group(entries: DataFrame) -> int:
    """How many entries the content has that most entries share; partial counts meet before the exchange."""
    return entries.groupBy(*GROUP).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def canonical_files(entries: DataFrame) -> DataFrame:
    """The canonical entry of each group of two or more: path, size, digest, n."""
    return dupe_groups(entries).select(F.col("canonical_path").alias("path"), *GROUP, "n")


def dupe_pairs(entries: DataFrame, dry_run: bool = False, skewed: bool = False) -> DataFrame:
    """A pair for each entry but the canonical: k equal files give k - 1 pairs, all with the same canonical.

    A dry run leaves out what is a hard link to the canonical already; an applied one reports it later.
    """
    if dry_run:
        pairs = elect(entries, skewed).where("path <> canonical_path AND NOT (device = canonical_device AND inode = canonical_inode)")
    else:  # paths alone: no other column takes part in the exchange
        slim = entries.select("path", *GROUP)
        if skewed:
            held = slim.join(slim.groupBy(*GROUP).agg(F.min("path").alias("canonical_path"), F.count("*").alias("n")).where("n > 1"), list(GROUP))
        else:
            held = slim.withColumn("canonical_path", F.min("path").over(Window.partitionBy(*GROUP)))
        pairs = held.where("path <> canonical_path")
    return pairs.select("canonical_path", F.col("path").alias("duplicate_path"), "digest", F.col("size").alias("size_bytes"))


def in_order(pairs: DataFrame) -> DataFrame:
    """Pairs by size, digest and duplicate path."""
    return pairs.orderBy("size_bytes", "digest", "duplicate_path")


def placed(ordered: DataFrame) -> DataFrame:
    """Rows of an ordered table with their place in it, from 0. Only the sizes of its partitions are summed in one task."""
    ordered = ordered.checkpoint() if ordered.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else ordered.persist()
    marked = ordered.withColumn("_at", F.monotonically_increasing_id())
    part, here = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    return marked.withColumn("_part", part).join(F.broadcast(ahead), "_part").select((F.col("_ahead") + here).alias("place"), *ordered.columns)


def dry_run_results(pairs: DataFrame) -> DataFrame:
    """What a dry run reports for its pairs."""
    return pairs.select(*DUPE_PAIR, F.lit(SKIPPED).alias("status"), F.lit(SAYS_DRY_RUN).alias("message"))


def distinct_inodes(entries: DataFrame) -> DataFrame:
    return entries.select("device", "inode").distinct()


def savings(pairs: DataFrame) -> DataFrame:
    """An extension: bytes that linking all pairs of a dry run would free."""
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))
