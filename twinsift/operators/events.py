"""Changes: what file-system events mean, what they leave, and which pairs they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DELETED, MODIFIED, SAYS_NOT_WRITABLE, SKIPPED
from .index import latest

# Names of the kernel's event kinds.
WRITTEN, REMOVED = ("CLOSE_WRITE", "MOVED_TO"), ("DELETE", "MOVED_FROM")
DIR_ADDED, DIR_GONE = ("CREATE", "MOVED_TO"), ("DELETE_SELF", "MOVE_SELF")


def classify(kind: Column, is_dir: Column, is_regular: Column) -> Column:
    """Modified, Deleted, Subscribe, Unsubscribe, or null for an event that means nothing.

    The creation of a file is nothing yet: its closing after writing tells. What is no regular file is not modified.
    """
    return (
        F.when(kind.isin(*DIR_GONE), "Unsubscribe")
        .when(is_dir & kind.isin(*DIR_ADDED), "Subscribe")
        .when(~is_dir & kind.isin(*WRITTEN) & is_regular, MODIFIED)
        .when(~is_dir & kind.isin(*REMOVED), DELETED)
    )


def fold(events: DataFrame, *order: str) -> DataFrame:
    """The last event of each path, by `order`."""
    return latest(events, "path", *order)


def live(events: DataFrame, *order: str) -> DataFrame:
    """Paths that are there after all events."""
    return fold(events, *order).where(F.col("type") == MODIFIED)


def matches(changed: DataFrame, index: DataFrame) -> DataFrame:
    """Each changed file (path, digest, size) that others equal: with the first other path of its digest, and how many others there are.

    Content alone counts. Of the index only entries of changed digests are grouped, and of each digest the two least
    paths are all that is needed: one row for each changed file, however many entries share a content.
    """
    held = index.select("path", "digest").join(changed.select("digest").distinct(), "digest", "left_semi")
    first = held.groupBy("digest").agg(F.min("path").alias("first"), F.count("*").alias("n"))
    second = held.join(first.select("digest", "first"), "digest").where("path <> first").groupBy("digest").agg(F.min("path").alias("second"))
    met = changed.select("path", "digest", "size").join(first, "digest").join(second, "digest", "left")
    other = F.when(F.col("path") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    return met.select("path", "digest", "size", other.alias("other_path"), (F.col("n") - 1).alias("others")).where("other_path IS NOT NULL")


def pairs_of_changes(changed: DataFrame, index: DataFrame) -> DataFrame:
    """One pair for each changed file: with the first other path of its digest; the lesser path is the canonical.

    Other matches are left alone, and hard links of each other are paired too: event handling differs from a scan here.
    """
    least, greatest = F.least("path", "other_path"), F.greatest("path", "other_path")
    return matches(changed, index).select(least.alias("canonical_path"), greatest.alias("duplicate_path"), "digest", F.col("size").alias("size_bytes"))


def unwritable_once(results: DataFrame) -> DataFrame:
    """Duplicate paths that could not be written: each is reported once."""
    return results.where((F.col("status") == SKIPPED) & (F.col("message") == SAYS_NOT_WRITABLE)).select("duplicate_path").distinct()
