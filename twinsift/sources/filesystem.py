"""File trees as a Spark source: `spark.read.format("file_tree")`.

Options: `roots` (joined by newlines), `exclude` (glob patterns of file names, joined by newlines, none by
default), `partitions` (target number). Rows follow schemas.SCANNED_FILE. Symbolic links are never followed nor
listed, hidden names are listed, and an unreadable directory below a root is skipped with a row that carries the
error; an unreadable root fails the scan. The driver looks for directories at the top until there are enough of
them to share out, and keeps no file; files are listed in the tasks, those of a large flat directory in several.
"""

from __future__ import annotations

import fnmatch
import os
import stat
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codecs import wrap_u64
from ..functions.hashing import Interrupted, hash_file
from ..schemas import META, SCANNED_FILE


def meta(path: str, follow: bool = False) -> dict[str, int]:
    """The metadata columns of a file; raises OSError if it is missing. Unsigned numbers wrap to signed ones."""
    s = os.stat(path, follow_symlinks=follow)
    got = (s.st_size, s.st_mtime_ns, s.st_ino, s.st_dev, s.st_mode, s.st_uid, s.st_gid)
    return {c: wrap_u64(v) for c, v in zip(META, got, strict=True)}


def is_plain(path: str) -> bool:
    """A regular file that is no symbolic link."""
    try:
        return stat.S_ISREG(os.lstat(path).st_mode)
    except OSError:
        return False


@dataclass
class Subtree(InputPartition):
    root: str
    top: str  # a directory
    deep: bool  # with all below it, or its own files only
    part: int = 0  # of a large directory's own files, those whose names hash to this part
    of: int = 1


def _row(root: str, path: str, error: str | None = None) -> tuple:
    try:
        s = meta(path)
    except OSError as e:
        return (root, path, False, *(None for _ in META), error or e.strerror)
    return (root, path, stat.S_ISREG(s["mode"]), *(s[c] for c in META), error)


def walk(root: str, top: str, exclude: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Rows of everything below `top` but symbolic links, however deep. A directory's error is a row; its siblings go on."""
    waiting = [top]
    while waiting:
        here = waiting.pop()
        try:
            with os.scandir(here) as it:
                found = sorted(it, key=lambda e: e.name)
        except OSError as e:
            yield _row(root, here, e.strerror)
            continue
        below = []
        for e in found:
            if e.is_symlink() or any(fnmatch.fnmatch(e.name, x) for x in exclude):
                continue
            if e.is_dir(follow_symlinks=False):
                below.append(e.path)
            else:
                yield _row(root, e.path)
        waiting += reversed(below)


def own_files(p: Subtree, exclude: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of one part of a directory's own files."""
    try:
        with os.scandir(p.top) as it:
            for e in it:
                if zlib.crc32(os.fsencode(e.name)) % p.of == p.part and not e.is_symlink() and not e.is_dir(follow_symlinks=False) and not any(fnmatch.fnmatch(e.name, x) for x in exclude):
                    yield _row(p.root, e.path)
    except OSError as e:
        if p.part == 0:
            yield _row(p.root, p.top, e.strerror)


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str], exclude: tuple[str, ...], target: int, share: int = 10_000) -> None:
        self.roots, self.exclude, self.target, self.share = roots, exclude, target, share

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for root in self.roots:
            whole = os.path.realpath(root)
            level = [whole]
            with os.scandir(whole):
                pass  # an unreadable root fails here
            while level and len(level) < self.target:  # names are looked at one by one, only directories are kept
                below: list[str] = []
                for d in level:
                    files = 0
                    try:
                        with os.scandir(d) as it:
                            for e in it:
                                if e.is_symlink() or any(fnmatch.fnmatch(e.name, x) for x in self.exclude):
                                    continue
                                if e.is_dir(follow_symlinks=False):
                                    below.append(e.path)
                                else:
                                    files += 1
                    except OSError:
                        files = 1  # the task reports the error
                    of = -(-files // self.share)
                    parts += [Subtree(whole, d, False, k, of) for k in range(of)]
                level = sorted(below)
            parts += [Subtree(whole, d, True) for d in level]
        return parts or [Subtree("", "", False, 0, 1)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        if partition.top:
            yield from walk(partition.root, partition.top, self.exclude) if partition.deep else own_files(partition, self.exclude)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self):
        return SCANNED_FILE

    def reader(self, schema) -> DataSourceReader:
        lines = lambda k: [x for x in self.options.get(k, "").split("\n") if x]
        return TreeReader(lines("roots"), tuple(lines("exclude")), int(self.options.get("partitions", "32")))


def scan(spark: SparkSession, roots: list[str], exclude: tuple[str, ...] = (), partitions: int = 32) -> DataFrame:
    """All entries below the roots, root after root; a path below two roots is listed twice."""
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(roots="\n".join(roots), exclude="\n".join(exclude), partitions=partitions).load()


def digests(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """device, inode, digest and error of each file (path, device, inode, size), read in chunks by the tasks.

    Files are dealt out by a hash of their path, so that a directory of large files spreads over the tasks. A
    file that cannot be read has an error and no digest.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path, device, inode in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    out.append((device, inode, hash_file(path, algorithm), None))
                except (OSError, Interrupted) as e:
                    out.append((device, inode, None, str(e)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["device", "inode", "digest", "error"])

    return files.select("path", "device", "inode").repartition("path").mapInArrow(run, "device long, inode long, digest string, error string")


def metas(paths: DataFrame) -> DataFrame:
    """path and metadata of those paths (column path) that are regular files now, looked at by the tasks."""
    from pyspark.sql.types import StructType

    from ..schemas import FILE_META

    schema = StructType([SCANNED_FILE["path"], *FILE_META.fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                if is_plain(path):
                    try:
                        m = meta(path)
                    except OSError:
                        continue  # gone since: its own event tells
                    out.append((path, *(m[c] for c in META)))
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return paths.select("path").mapInArrow(run, schema)
