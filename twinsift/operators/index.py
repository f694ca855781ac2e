"""The index: paths over inodes, as pure functions from snapshots to snapshots.

paths: path, device, inode, last_seen. inodes: device, inode, size, mtime_ns, mode, uid, gid, digest, last_seen.
Hard links share an inode's row. There is no MERGE on plain Parquet: an upsert is a union in which the new rows
of a key win, and a snapshot is replaced as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INODE = ("device", "inode")
INODE_COLUMNS = ("device", "inode", "size", "mtime_ns", "mode", "uid", "gid", "digest", "last_seen")
PATH_COLUMNS = ("path", "device", "inode", "last_seen")


def entries(paths: DataFrame, inodes: DataFrame) -> DataFrame:
    """Paths with their inode's metadata and digest; last_seen is the path's."""
    return paths.join(inodes.drop("last_seen"), list(INODE)).select("path", "size", "mtime_ns", "inode", "device", "mode", "uid", "gid", "digest", "last_seen")


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, inodes) of entries. Of entries that disagree on a key, the last by (last_seen, path) stands."""
    paths = last_of(found, ("path",), ("last_seen", "device", "inode")).select(*PATH_COLUMNS)
    inodes = last_of(found, INODE, ("last_seen", "path")).select(*INODE_COLUMNS)
    return paths, inodes


def last_of(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key: a maximum of structs, so that copies meet before the exchange."""
    rest = [c for c in rows.columns if c not in order]
    best = F.max(F.struct(*order, F.struct(*rest).alias("_rest"))).alias("_best")
    picked = rows.groupBy(*(F.col(c).alias(f"_key_{c}") for c in key)).agg(best)
    return picked.select(*(F.col(f"_best.{c}") for c in order), *(F.col(f"_best._rest.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(paths: DataFrame, inodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, inodes) after the entries `found`: new rows replace those of their key as a whole.

    An inode that a path has left, and that no other path holds, goes.
    """
    new_paths, new_inodes = split(found)
    all_paths = paths.select(*PATH_COLUMNS).join(new_paths.select("path"), "path", "left_anti").unionByName(new_paths)
    all_inodes = inodes.select(*INODE_COLUMNS).join(new_inodes.select(*INODE), list(INODE), "left_anti").unionByName(new_inodes)
    return all_paths, all_inodes.join(all_paths.select(*INODE), list(INODE), "left_semi").select(*INODE_COLUMNS)


def changes(paths: DataFrame, inodes: DataFrame, found: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What entries `found` and removed paths `gone` (column path) change: (new paths, paths that go, new inodes, inodes that go).

    upsert(remove(...)) as a delta: only rows of the changed paths and of the inodes that they hold or have left.
    """
    new_paths, new_inodes = split(found)
    out = gone.select("path").join(new_paths.select("path"), "path", "left_anti").distinct()
    touched = new_paths.select("path").unionByName(out)
    left = paths.join(touched, "path", "left_semi").select(*INODE).distinct().join(new_inodes.select(*INODE), list(INODE), "left_anti")
    others = paths.join(left, list(INODE), "left_semi").join(touched, "path", "left_anti").select(*INODE)
    return new_paths, out, new_inodes, left.join(others, list(INODE), "left_anti")


def find_by_path(index: DataFrame, path: str) -> DataFrame:
    return index.where(F.col("path") == path)


def find_by_inode(paths: DataFrame, inodes: DataFrame, device: int, inode: int) -> DataFrame:
    """The inode's row with its first path, or '' if it has none; last_seen is the inode's."""
    here = (F.col("device") == device) & (F.col("inode") == inode)
    first = paths.where(here).groupBy(*INODE).agg(F.min("path").alias("path"))
    return inodes.where(here).join(first, list(INODE), "left").withColumn("path", F.coalesce("path", F.lit("")))


def first_paths(paths: DataFrame, inodes: DataFrame) -> DataFrame:
    """find_by_inode for all inodes at once."""
    first = paths.groupBy(*INODE).agg(F.min("path").alias("path"))
    return inodes.join(first, list(INODE), "left").withColumn("path", F.coalesce("path", F.lit("")))


def find_by_digest(index: DataFrame, digest: str) -> DataFrame:
    """All entries with the digest, by path."""
    return index.where(F.col("digest") == digest).orderBy("path")


def retain(paths: DataFrame, cutoff: int, roots: list[str] | None = None) -> DataFrame:
    """Paths seen at the cutoff or later. With `roots`, only paths under them can go."""
    keep = F.col("last_seen") >= cutoff
    if roots is not None:
        under = F.lit(False)
        for root in roots:
            under = under | F.col("path").startswith(root.rstrip("/") + "/")
        keep = keep | ~under
    return paths.where(keep)


def orphans(paths: DataFrame, inodes: DataFrame) -> DataFrame:
    """Inodes that no path holds."""
    return inodes.join(paths.select(*INODE), list(INODE), "left_anti")


def prune(paths: DataFrame, inodes: DataFrame) -> DataFrame:
    return inodes.join(paths.select(*INODE), list(INODE), "left_semi")


def remove(paths: DataFrame, inodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, inodes) without the paths in `gone` (column path), and without the inodes that only they held."""
    left = paths.join(gone.select("path"), "path", "left_anti").select(*PATH_COLUMNS)
    went = paths.join(gone.select("path"), "path", "left_semi").select(*INODE).distinct()
    bare = went.join(left.select(*INODE), list(INODE), "left_anti")
    return left, inodes.join(bare, list(INODE), "left_anti").select(*inodes.columns)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by `order`; of rows alike in that, the greatest. A key may have any share of all rows."""
    return last_of(rows, (key,), order)
