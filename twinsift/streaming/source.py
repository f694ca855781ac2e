"""Changes of file trees as a streaming source: `spark.readStream.format("file_changes")`.

The source takes the kernel's events between triggers. At its start, and when the kernel has dropped events, it lists
the trees and compares with the last listing that it has kept, so nothing is lost while no one looks: files inside a
new directory, changes before the first trigger, and renames of directories are all seen. Events are kept in a journal
folder, so a batch that is read again gives the same ones; after a restart some may come twice, which the index bears.
Where the kernel has no events for us (`poll`, or no more watches to have), trees are listed at each trigger.
Options: roots (joined by newlines), journal (a local folder of the driver), poll (true: always list).

Rows are raw events; `changes` gives each its meaning by operators.events.classify.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators import events
from ..operators.events import REMOVED, WRITTEN
from ..schemas import DELETED, MODIFIED, RAW_EVENT
from ..sources.filesystem import walk
from .kernel import Overflow, Watches

log = logging.getLogger("twinsift")

#: Places of size, mtime, inode and device in a row of walk().
_STATE = (3, 4, 5, 6)


def listing(roots: list[str]) -> dict[str, list[int]]:
    return {row[1]: [row[i] for i in _STATE] for root in roots for row in walk(root, os.path.realpath(root)) if row[2]}


def differences(before: dict, after: dict) -> list[tuple[str, str, bool, bool]]:
    """Events in order of paths: what is new or has other metadata was written, what is gone was deleted."""
    return sorted([(p, "CLOSE_WRITE", False, True) for p, m in after.items() if before.get(p) != m] + [(p, "DELETE", False, False) for p in before.keys() - after.keys()])


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, roots: list[str], journal: str, poll: bool = False) -> None:
        self.roots, self.journal, self.poll = [os.path.realpath(r) for r in roots], journal, poll
        self.watches: Watches | None = None
        self.known: dict | None = None
        os.makedirs(journal, exist_ok=True)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"watches": None, "known": None}

    def _load(self, name: str):
        try:
            with open(os.path.join(self.journal, f"{name}.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _save(self, name: str, data) -> None:
        place = os.path.join(self.journal, f"{name}.json")
        with open(place + ".new", "w") as f:
            json.dump(data, f)
        os.replace(place + ".new", place)

    def initialOffset(self) -> dict:
        return {"k": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        k = start["k"]
        events = self._load(f"{k + 1:012d}")
        if events is None:  # not read before: look now
            events, listed = self._look()
            if not events:
                return iter(()), start
            self._save(f"{k + 1:012d}", events)
            if listed:
                self._save("listing", self.known)
        return iter([(i, *e) for i, e in enumerate(events)]), {"k": k + 1}

    def _look(self) -> tuple[list[tuple], bool]:
        """(new events, whether they come from a listing)."""
        if self.watches and self.known is not None:
            try:
                return self._heard(self.watches.read()), False
            except Overflow:
                log.warning("The kernel has dropped events; the trees are listed again.")
                self.watches.close()
                self.watches = Watches(self.roots)
        elif not self.poll and self.watches is None:
            try:
                self.watches = Watches(self.roots)  # before the listing, so that nothing falls between
            except OSError as e:
                log.warning("Trees are listed at each trigger: %s", e)
                self.poll = True
        before = self.known if self.known is not None else self._load("listing") or {}
        self.known = listing(self.roots)
        return differences(before, self.known), True

    def _heard(self, events: list[tuple]) -> list[tuple]:
        """The kernel's events, once each in a row; a directory that has moved away takes its files with it."""
        out: list[tuple] = []
        for path, kind, is_dir, regular in events:
            if is_dir and kind == "MOVED_FROM":
                out += [(p, "MOVED_FROM", False, False) for p in sorted(self.known) if p.startswith(path + "/")]
            out.append((path, kind, is_dir, regular))
        for path, kind, is_dir, regular in out:
            if not is_dir and kind in WRITTEN and regular:
                self.known[path] = None
            elif not is_dir and kind in REMOVED:
                self.known.pop(path, None)
        return [e for e, before in zip(out, [None, *out], strict=False) if e != before]

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for k in range(start["k"] + 1, end["k"] + 1):
            yield from ((i, *e) for i, e in enumerate(self._load(f"{k:012d}") or []))

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.journal):
            k = name.split(".")[0]
            if k.isdigit() and int(k) < end["k"]:
                os.remove(os.path.join(self.journal, name))


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self):
        return RAW_EVENT

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return ChangeReader([r for r in self.options["roots"].split("\n") if r], self.options["journal"], self.options.get("poll", "").lower() == "true")


def changes(spark: SparkSession, roots: list[str], journal: str, poll: bool = False) -> DataFrame:
    """The streaming DataFrame of changes below the roots: seq, path, type (Modified or Deleted)."""
    for root in roots:
        with os.scandir(root):
            pass  # a root that cannot be read fails at once
    spark.dataSource.register(FileChanges)
    raw = spark.readStream.format("file_changes").options(roots="\n".join(roots), journal=journal, poll=str(poll).lower()).load()
    means = events.classify(F.col("kind"), F.col("is_dir"), F.col("is_regular"))
    return raw.select("seq", "path", means.alias("type")).where(F.col("type").isin(MODIFIED, DELETED))
