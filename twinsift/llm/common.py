"""What the operators share: whole-text Arrow functions, bounded training samples, lineage cuts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words between the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A-Z to a-z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Texts and characters that a function gets at a time. Arrow batches themselves are bounded in bytes by Spark.
SLICE_ROWS, SLICE_CHARS = 512, 1 << 20
#: Characters of a training text: a stretch of so many, from anywhere in it, is fetched. Bounds what the driver gets.
CHARS = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only; other letters stay as they are."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def text_function(f: Callable[[str], tuple], schema: str, spark: SparkSession) -> Callable[[Column], Column]:
    """An Arrow function that maps each whole text (null: empty) to a struct of type `schema`.

    `f` makes one tuple, in the order of the schema's fields. It is marked nondeterministic only so that
    Spark never evaluates it twice, in a pushed filter and again in a projection.
    """
    names = [x.split()[0] for x in schema.split(",")]
    return batch_function(lambda texts: dict(zip(names, zip(*map(f, texts)), strict=True)), schema, spark)


def batch_function(f: Callable[[list[str]], dict[str, Sequence]], schema: str, spark: SparkSession) -> Callable[[Column], Column]:
    """As text_function, for an `f` from a list of texts to a dictionary of columns."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(schema))

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for some in slices(texts):
            got = f(some)
            parts.append(pa.StructArray.from_arrays([pa.array(got[x.name], x.type) for x in kind], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema).asNondeterministic()


def slices(texts: pa.Array, limit: int = SLICE_CHARS, rows: int = SLICE_ROWS) -> Iterator[list[str]]:
    """The texts in runs of about `limit` characters and `rows` texts at most; a longer text is a run of its own."""
    run, size = [], 0
    for x in texts:
        text = x.as_py() or ""
        if run and (size + len(text) > limit or len(run) == rows):
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of Arrow batches, SLICE_ROWS at a time: bounds the Python objects made of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield list(zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True))


def stretch(text: Column, key: Column, chars: int = CHARS) -> Column:
    """A stretch of at most `chars` characters of the text, from a place that a hash of the key chooses."""
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, F.pmod(F.xxhash64(key, F.lit(1)), room).cast("int") + 1, F.lit(chars))


def least_ids(rows: DataFrame, key: str, group: str, sizes: dict, seed: int) -> list[tuple]:
    """(id, group) of the sizes[group] ids of each group with the smallest hashes: the same ones at each run.

    Only ids and groups are read. The groups' counts give a bound on the hash that lets about twice as many rows
    pass; those are made distinct and ordered. Where repeated ids leave too few, the bound is raised.
    """
    place = F.xxhash64(F.col(key), F.lit(seed)) / float(1 << 64) + 0.5  # in 0..1
    counts = {r[0]: r[1] for r in rows.where(F.col(group).isin(list(sizes))).groupBy(group).count().collect()}
    share = {g: min(1.0, (2 * sizes[g] + 100) / n) for g, n in counts.items()}
    out: list[tuple] = []
    while share:
        passed = F.lit(False)
        for g, f in share.items():
            passed = passed | ((F.col(group) == F.lit(g)) & (place <= f))
        few = rows.where(passed).select(group, key, place.alias("_place")).distinct()
        ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_place", key)))
        most = F.create_map(*(F.lit(x) for g in share for x in (g, sizes[g])))
        got: dict = {g: [] for g in share}
        for r in ranked.where(F.col("_rank") <= most[F.col(group)]).select(key, group).collect():
            got[r[1]].append((r[0], r[1]))
        out += [x for g, ids in got.items() if len(ids) >= sizes[g] or share[g] >= 1 for x in ids]
        share = {g: min(1.0, 8 * share[g]) for g, ids in got.items() if len(ids) < sizes[g] and share[g] < 1}
    return sorted(out, key=repr)


def texts_of(docs: DataFrame, ids: list[tuple], kind: str, doc_id: str = "doc_id", text: str = "text", chars: int = CHARS) -> list[tuple[str, object]]:
    """(stretch of the text, group) of each chosen id; of rows that share an id, the text with the least hash."""
    if not ids:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, f"_id {docs.schema[doc_id].dataType.simpleString()}, _group {kind}"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL").join(chosen, "_id")
    one = rows.groupBy("_id", "_group").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), stretch(F.col("_text"), F.col("_id"), chars).alias("t"))).alias("s"))
    return [(r["t"], r["_group"]) for r in sorted(one.select("_id", "_group", "s.t").collect(), key=lambda r: (repr(r["_id"]), repr(r["_group"])))]


def shared_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder: the cluster's spark.checkpoint.dir; where it is unset, one of this machine's if Spark runs on it alone."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="twinsift-"))


def cut(rows: DataFrame) -> DataFrame:
    """The rows from the shared folder: lineage ends here, and the loss of an executor costs no more than a reread.

    Spark deletes them when nothing refers to them any more, if the session was made with
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sizes: tuple[int, int], seed: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """A bounded training sample: (text, label) of at most `sizes` ids labelled 0 and 1, outside the held-out fold.

    The ids are those with the smallest hashes, so each run has the same ones. Rows without id, label or text are
    left out. An id counts once with each label it has, by a stretch of at most CHARS characters of its text.
    """
    free = labels.where(remainder(F.col(doc_id), 3) != 1).select(doc_id, F.col(label).cast("int").alias("_label"))
    ids = least_ids(free, doc_id, "_label", dict(enumerate(sizes)), seed)
    return texts_of(docs, ids, "int", doc_id, text)


def pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about `limit` characters that end before ASCII white space: bounds the lists made from it."""
    at = 0
    while len(text) - at > limit:
        end = at + limit
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, steps: int = 60, each: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one the bias) of a regularised logistic regression, by Newton's method. `each`: how much each row counts."""
    x = np.c_[x, np.ones(len(x))]
    each = np.ones(len(y)) if each is None else each * len(y) / each.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (each * p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (each * (p - y)) / len(y) + decay * w)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w
