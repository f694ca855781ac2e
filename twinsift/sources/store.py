"""The index at rest: Parquet tables and a pointer to the current ones.

A commit writes new table folders and then replaces the pointer in one rename, so a reader sees either the old
or the new index and a crash leaves at most an unused folder. A merge writes only what changes: a folder of new rows
and of keys that go; readers put it over the rows before, and after MERGE of them the table is written as one again.
Paths go through Hadoop's file system, so the index may live anywhere that Spark writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..operators.index import last_of
from ..schemas import INODES, OP_EVENTS, PATHS

VERSION = 1
#: Additions to a table before they are merged.
MERGE = 64
TABLES = {"paths": PATHS, "inodes": INODES, "op_log": OP_EVENTS}
KEYS = {"paths": ("path",), "inodes": ("device", "inode")}
#: Marks the folder of a merge: rows of the table, and in _gone whether the key only goes.
DELTA, DELTAS = "delta", StructType([StructField("_gone", BooleanType()), StructField("_n", LongType())])


class IndexStore:
    """`folder` holds table folders and the file CURRENT, which names the folders of each table. `algorithm`: the digests' kind."""

    def __init__(self, spark: SparkSession, folder: str, algorithm: str = "sha256") -> None:
        self.spark, self.folder, self.algorithm = spark, folder.rstrip("/"), algorithm
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._fs.mkdirs(self._at(""))
        said = self._pointer()
        if said["algorithm"] != algorithm:
            raise ValueError(f"the index holds {said['algorithm']} digests, not {algorithm}: they are never mixed")

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _pointer(self) -> dict:
        if not self._fs.exists(self._at("CURRENT")):
            return {"version": VERSION, "algorithm": self.algorithm, "tables": {}, "unused": []}
        stream = self._fs.open(self._at("CURRENT"))
        try:
            data = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        finally:
            stream.close()
        return json.loads(bytes(data))

    def read(self, name: str) -> DataFrame:
        """A table as the pointer names it now; empty if nothing was committed."""
        folders = self._pointer()["tables"].get(name)
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self._over(name, folders)

    def _over(self, name: str, folders: list[str]) -> DataFrame:
        """The table's rows: whole folders, and over them its merges, the last one of a key first."""
        whole = [f"{self.folder}/{f}" for f in folders if DELTA not in f]
        merges = [f"{self.folder}/{f}" for f in folders if DELTA in f]
        rows = self.spark.read.schema(TABLES[name]).parquet(*whole) if whole else self.spark.createDataFrame([], TABLES[name])
        if not merges:
            return rows
        schema = StructType([*TABLES[name].fields, *DELTAS.fields])
        last = last_of(self.spark.read.schema(schema).parquet(*merges), KEYS[name], ("_n",))
        bare = rows.join(last.select(*KEYS[name]), list(KEYS[name]), "left_anti").select(*TABLES[name].names)
        return bare.unionByName(last.where("NOT _gone").select(*TABLES[name].names))

    def merge(self, **tables: tuple[DataFrame, DataFrame]) -> None:
        """Puts (new rows, keys that go) over tables, all at once; what is written grows with them and not with the table."""
        said, fresh = self._pointer()["tables"], {}
        for name, (rows, gone) in tables.items():
            folders = said.get(name, [])
            n = sum(DELTA in f for f in folders)
            folder = f"{name}-{DELTA}-{uuid.uuid4().hex}"
            none = [F.lit(None).cast(x.dataType).alias(x.name) for x in TABLES[name].fields if x.name not in KEYS[name]]
            went = gone.select(*KEYS[name], *none, F.lit(True).alias("_gone"))
            both = rows.select(*TABLES[name].names, F.lit(False).alias("_gone")).unionByName(went).withColumn("_n", F.lit(n).cast("long"))
            both.write.parquet(f"{self.folder}/{folder}")
            folders = [*folders, folder]
            fresh[name] = folders if n < MERGE else [self._write(name, self._over(name, folders))]
        self._publish(fresh)

    def commit(self, **tables: DataFrame) -> None:
        """Replaces the tables given, all at once; the others stay as they are. vacuum() deletes what was replaced."""
        self._publish({k: [self._write(k, rows)] for k, rows in tables.items()})

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a table; many small additions are merged now and then."""
        folders = [*self._pointer()["tables"].get(name, []), self._write(name, rows.coalesce(1))]
        if len(folders) > MERGE:
            folders = [self._write(name, self.spark.read.schema(TABLES[name]).parquet(*(f"{self.folder}/{f}" for f in folders)))]
        self._publish({name: folders})

    def scratch(self, name: str) -> str:
        """A folder beside the tables that the next vacuum() deletes."""
        said = self._pointer()
        self._point(said | {"unused": [*said["unused"], name]})
        return f"{self.folder}/{name}"

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        order = {"inodes": "digest", "paths": "path"}.get(name)  # lookups prune row groups by these
        rows = rows.select(*TABLES[name].names)
        (rows.sortWithinPartitions(order) if order else rows).write.parquet(f"{self.folder}/{folder}")
        return folder

    def _publish(self, fresh: dict[str, list[str]]) -> None:
        said = self._pointer()
        tables = said["tables"] | fresh
        live = {f for fs in tables.values() for f in fs}
        unused = said["unused"] + [f for fs in said["tables"].values() for f in fs if f not in live]
        self._point({"version": VERSION, "algorithm": self.algorithm, "tables": tables, "unused": unused})

    def vacuum(self) -> None:
        """Deletes what commits have replaced. DataFrames read before those commits are void from here on."""
        said = self._pointer()
        if said["unused"]:
            for f in said["unused"]:
                self._fs.delete(self._at(f), True)
            self._point(said | {"unused": []})

    def _point(self, said: dict) -> None:
        text = json.dumps(said)
        new = self._at(f"CURRENT.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        replace = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        replace[0] = self._hadoop.Options.Rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(new, self._at("CURRENT"), replace)

    @property
    def paths(self) -> DataFrame:
        return self.read("paths")

    @property
    def inodes(self) -> DataFrame:
        return self.read("inodes")

    @property
    def op_log(self) -> DataFrame:
        return self.read("op_log")
