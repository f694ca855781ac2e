"""Near copies: SimHash candidates from the Gray-order index, verified by the exact similarity of word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of `similarity` or more.
Candidates come from the index of `simhash`, with fingerprints of 128 bits over three-word shingles (a changed word
touches fewer of them, and with 128 bits unlike texts never come near each other by chance). The upper nodes are the
masks of `agree` of `blocks` equal runs of the first or of the last 64 bits; a leaf's tree finds the fingerprints within `limit`
bits, and leaves with more fingerprints than a task should hold are searched in pairs of parts. Components of these
candidates are clusters; in each cluster all texts are compared with its least one first, then only pairs that the
verified links leave apart, on whole sets; a large cluster is cut into parts of which each two meet in a task. Texts
with equal sets are one from the start.

A link is found if in one of the two words at least `agree` runs are equal, and no more than `limit` bits differ in
all. Up to 2 * (blocks - agree) + 1 differing bits that is certain, beyond it likely; the README has the measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, pieces, text_function
from .simhash import LEAF, components, forest_links, keep_least, mask_of, signed

#: Words of a shingle that is compared, of one that is fingerprinted, and the least similarity of near copies.
WIDTH, PRINTED, SIMILARITY = 5, 3, 0.8
#: Runs of each word, how many of them a node's mask fixes, most differing bits of 128; keys up to which texts are fetched by a broadcast.
BLOCKS, AGREE, LIMIT, BROADCAST = 8, 2, 26, 100_000
#: Texts of a cluster whose sets a task holds at a time, twice.
PART = 4_000
SEED = 42
#: The finalizer of the SplitMix64 generator, and odd factors for places in a shingle.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def joined(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, of the hashes of words."""
    n = len(h) - width + 1
    x = h[:n] * FACTORS[0]
    for k in range(1, width):
        x = x + h[k : k + n] * FACTORS[k]
    return mixed(x)


class Shingles:
    """The set of shingles, and the votes of the fingerprint, of one text."""

    def __init__(self, text: str, width: int = WIDTH, printed: int = PRINTED) -> None:
        self.votes, self.n, parts, most = np.zeros(128, np.int64), 0, [], max(width, printed)
        tail, fresh = np.zeros(0, np.uint64), 0
        for piece in pieces(ascii_lower(text)):
            got = np.array([xxhash.xxh64_intdigest(w, SEED) for w in WORD.findall(piece)], np.uint64)
            h = np.concatenate([tail, got])
            if len(h) >= width:  # runs that end in the new words
                parts.append(np.unique(joined(h[max(0, len(tail) - width + 1) :], width)))
            if len(h) >= printed:
                self.vote(joined(h[max(0, len(tail) - printed + 1) :], printed))
            fresh += len(got)
            tail = h[-(most - 1) :] if most > 1 else h[:0]
        if fresh and not parts:
            parts.append(joined(tail, len(tail)))
        if fresh and not self.n:
            self.vote(joined(tail, len(tail)))
        self.set = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def vote(self, hashes: np.ndarray) -> None:
        self.n += len(hashes)
        for at in range(0, len(hashes), 4096):
            h = hashes[at : at + 4096]
            both = np.stack([h, mixed(h ^ FACTORS[63])], 1)
            self.votes += np.unpackbits(both.astype(">u8").view(np.uint8).reshape(len(h), 16), axis=1).sum(0, dtype=np.int64)

    def fingerprint(self) -> tuple[int, int]:
        b = np.packbits(2 * self.votes > self.n).tobytes()
        return int.from_bytes(b[:8], "big"), int.from_bytes(b[8:], "big")


def signature(text: str, width: int = WIDTH) -> tuple[int, int, int, int]:
    """A hash of the set of shingles, the set's size, and the two words of the fingerprint."""
    s = Shingles(text, width)
    if not len(s.set):
        return 0, 0, 0, 0
    return signed(xxhash.xxh64_intdigest(s.set.tobytes(), SEED)), len(s.set), *map(signed, s.fingerprint())


def masks_for(blocks: int = BLOCKS, agree: int = AGREE) -> list[int]:
    """The masks of the upper nodes: all choices of `agree` of `blocks` runs of a word."""
    runs = [list(range(64 * k // blocks, 64 * (k + 1) // blocks)) for k in range(blocks)]
    return [mask_of(sum(some, [])) for some in combinations(runs, agree)]


def vertex(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a fingerprint; as in _candidates."""
    return a ^ (b << 21 | (b >> 43) & ((1 << 21) - 1))


def _row_keys(docs: DataFrame, doc_id: str, text: str) -> dict:
    return {"_none": F.col(doc_id).isNull(), "_mark": F.xxhash64(F.col(text)), "_id": F.coalesce(F.col(doc_id), F.lit(0).cast(docs.schema[doc_id].dataType))}


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(key, x): the set of each wanted key, from the text of its least row."""
    none = F.lit(0).cast(docs.schema[doc_id].dataType)
    rows = wanted.select("key", F.col("least.none").alias("_none"), F.col("least.mark").alias("_mark"), F.coalesce("least.doc_id", none).alias("_id"))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST else rows
    keys = _row_keys(docs, doc_id, text)
    texts = docs.select(F.col(text).alias("_text"), *(c.alias(k) for k, c in keys.items())).join(rows, list(keys)).select("key", "_text").dropDuplicates(["key"])
    made = text_function(lambda t: (Shingles(t, width).set.view(np.int64),), "x array<long>", docs.sparkSession)
    return cut(texts.select("key", made(F.col("_text"))["x"].alias("x")))


def _meetings(key: F.Column, parts: F.Column) -> F.Column:
    """The meetings that a row takes part in, if its group is cut by `key` into parts of which each two meet, and each with itself."""
    own = F.pmod(F.xxhash64(key), parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.least(x, own) * parts + F.greatest(x, own))


def _candidates(prints: DataFrame, limit: int, blocks: int, agree: int, leaf: int) -> DataFrame:
    """Edges (a, b) that connect the vertices of all fingerprints that meet in a node and differ in `limit` bits or fewer. prints: f, g."""
    masks = masks_for(blocks, agree)
    named = enumerate((word, x) for word in ("f", "g") for x in masks)
    nodes = F.explode(F.array(*(F.struct(F.lit(k).cast("short").alias("m"), F.col(word).bitwiseAND(F.lit(x)).alias("bits")) for k, (word, x) in named)))
    spread = prints.select("f", "g", nodes.alias("node")).select("node.m", "node.bits", "f", "g")
    large = cut(spread.groupBy("m", "bits").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("m", "bits", F.ceil(F.col("n") / leaf).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = spread.withColumn("part", F.lit(0))
    else:  # each part of a large node meets each other part, and itself, in a leaf of its own
        placed = spread.join(F.broadcast(large) if large.count() <= BROADCAST else large, ["m", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = placed.withColumn("part", F.explode(_meetings(F.xxhash64("f", "g"), F.col("parts"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(x: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[False], (x[1:, :3] != x[:-1, :3]).any(1)])
            both = forest_links(np.cumsum(new), np.ascontiguousarray(x[:, 3:]).view(np.uint64), vertex(x[:, 3], x[:, 4]), limit)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in both], names=["a", "b"])

        held: list[np.ndarray] = []
        rows, enough = 0, leaf
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            held.append(x)
            rows += len(x)
            if rows >= enough:  # whole leaves go, the last one may go on
                x = np.concatenate(held)
                same = (x[:, :3] == x[-1, :3]).all(1)
                k = len(x) - int(np.argmin(same[::-1])) if not same.all() else 0
                if k:
                    yield links(x[:k])
                held, rows = [x[k:].copy()], len(x) - k
                enough = max(leaf, 2 * rows)
        if held and (x := np.concatenate(held)).size:
            yield links(x)

    return dealt.select("m", "bits", "part", "f", "g").repartition("m", "bits", "part").sortWithinPartitions("m", "bits", "part").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("key").alias("b"), F.col("x").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return cut(both.where(common >= F.lit(similarity) * (F.size("xa") + F.size("xb") - common)).select("a", "b"))


def cluster_links(keys: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between texts of a cluster in different components: each joins two."""
    sizes, out = np.array([len(x) for x in sets]), []
    places = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    starts = np.cumsum(sizes) - sizes
    held, roots = np.zeros(places.max() + 1, bool), roots.copy()
    for i in range(len(keys) - 1):
        j = np.arange(i + 1, len(keys))
        j = j[(roots[j] != roots[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]))]
        if not len(j):
            continue
        own = places[starts[i] : starts[i] + sizes[i]]
        held[own] = True
        common = np.array([np.count_nonzero(held[places[starts[k] : starts[k] + sizes[k]]]) for k in j.tolist()])
        held[own] = False
        for k in j[common >= similarity * (sizes[j] + sizes[i] - common)].tolist():
            if roots[k] != roots[i]:
                out.append((int(keys[i]), int(keys[k])))
                roots[roots == roots[k]] = roots[i]
    return out


def _linked(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) in clusters of several components. rows: cluster, part, key, root, x; the sets of a (cluster, part) are in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple]) -> pa.RecordBatch:
            keys, roots, sets = zip(*held, strict=True)
            got = cluster_links(np.array(keys), np.array(roots), list(sets), similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            cluster, part, key, root, x = batch.columns
            for i, k in enumerate(zip(cluster.to_pylist(), part.to_pylist(), strict=True)):
                if held and k != now:
                    yield links(held)
                    held = []
                now = k
                held.append((key[i].as_py(), root[i].as_py(), x[i].values.to_numpy()))
        if held:
            yield links(held)

    dealt = rows.select("cluster", "part", "key", "root", "x").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "key")
    return cut(dealt.mapInArrow(run, "a long, b long"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, limit: int = LIMIT, blocks: int = BLOCKS, agree: int = AGREE, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """(key, least, root): each distinct set of shingles, its least row (whether the id is null, id, hash of the text), and its component's least key."""
    made = text_function(partial(signature, width=width), "key long, n long, f long, g long", docs.sparkSession)(F.col(text))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), made.alias("s")).select("doc_id", "mark", "s.*")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")
    distinct = cut(own.groupBy("key").agg(least, F.first("n").alias("n"), F.first("f").alias("f"), F.first("g").alias("g")))

    some = distinct.where("n > 0")
    near = components(_candidates(some.select("f", "g").distinct(), limit, blocks, agree, leaf))
    name = F.col("f").bitwiseXOR(F.shiftleft("g", 21).bitwiseOR(F.shiftright("g", 43).bitwiseAND(F.lit((1 << 21) - 1))))
    named = some.select("key", "n", name.alias("node")).join(near, "node", "left").select("key", "n", F.coalesce("root", "node").alias("cluster"))
    heads = named.groupBy("cluster").agg(F.min(F.struct("key", "n")).alias("head"), F.count("*").alias("m")).where("m > 1").select("cluster", "head")
    members = cut(named.join(heads, "cluster"))
    sets = _sets(docs, distinct.join(members.select("key"), "key", "left_semi"), doc_id, text, width)

    alike = F.least("n", "head.n") >= F.lit(similarity) * F.greatest("n", "head.n")  # sizes that the similarity allows
    stars = members.where((F.col("key") != F.col("head.key")) & alike).select(F.col("head.key").alias("a"), F.col("key").alias("b"))
    edges = _verified(stars, sets, similarity)
    placed = members.join(components(edges).withColumnRenamed("node", "key"), "key", "left").select("cluster", "key", F.coalesce("root", "key").alias("root"))
    apart = placed.groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high").select("cluster", F.ceil(F.col("m") / part).cast("int").alias("parts"))
    unsettled = placed.join(apart, "cluster").withColumn("part", F.explode(_meetings(F.col("key"), F.col("parts"))))
    edges = edges.unionByName(_linked(unsettled.join(sets, "key"), similarity))
    roots = components(edges).withColumnRenamed("node", "key")
    return cut(distinct.select("key", "least").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, limit: int = LIMIT, blocks: int = BLOCKS, agree: int = AGREE, leaf: int = LEAF) -> DataFrame:
    """One row of each component of near copies, that with the least id (null ids last; then by a hash of the text); columns as in `docs`.

    Case (A-Z) and white space do not count. Null and empty texts are alike. Of rows that repeat id and text, one stays.
    An empty table stays empty; other columns are kept, whatever their names.
    """
    placed = groups(docs, doc_id, text, width, similarity, limit, blocks, agree, leaf)
    return keep_least(docs, cut(placed.groupBy("root").agg(F.min("least").alias("least"))), doc_id, text)
