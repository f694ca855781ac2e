"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are made once per document and grouped, so that copies count once. The index is a hierarchy of
masked bit patterns. Its upper nodes are distributed: a node is a mask and the bits that its fingerprints share
under it. The masks of the first level cut the 64 bits into three blocks; two fingerprints within two bits
agree on one block at least, so each linked pair meets in some node. A node that outgrows a task is refined by
cutting its free bits into three blocks again, which keeps this true. Inside a leaf, fingerprints stand in the
order of their Gray rank, neighbours are gathered into nodes of a tree whose masks hold the bits all of them
share, and a search descends the tree with accumulated differences, leaving whole groups as soon as these
exceed the limit. A leaf gives a spanning forest of its links; connected components follow on tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, pieces, text_function

SEED, LIMIT, FAN = 42, 2, 8
#: Fingerprints that one leaf may hold in a task.
LEAF = 50_000
ALL = (1 << 64) - 1


# fingerprints


def fingerprint(text: str) -> int:
    """SimHash of the 3-word shingles, repeats included; fewer words are one shingle, none give zero."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    h = xxhash.xxh64_intdigest
    for piece in pieces(ascii_lower(text)):
        words = tail + WORD.findall(piece)
        tail = words[-2:]
        if len(words) < 3:
            tail = words
            continue
        b = [w.encode() for w in words]
        flat, ends = b" ".join(b), list(accumulate(len(w) + 1 for w in b))
        hashes = np.array([h(flat[i : j - 1], SEED) for i, j in zip(chain((0,), ends), ends[2:])], dtype=np.uint64)
        n += len(hashes)
        for at in range(0, len(hashes), 4096):
            counts += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    if not n:
        return h(" ".join(tail).encode(), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# the leaf: a tree over Gray order


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_order(fps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order by group, then by the Gray rank of the fingerprints' bits, word after word."""
    ranks, odd = [], np.zeros(len(fps), np.uint64)
    for word in fps.T:
        ranks.append(gray_rank(word) ^ odd)  # an odd number of ones before reverses what follows
        odd = np.where(ranks[-1] & np.uint64(1), np.uint64(ALL), np.uint64(0))
    return np.lexsort((*reversed(ranks), group))


class GrayTree:
    """Leaves of several groups, each group in Gray order and all in one array; nodes never span two groups.

    Fingerprints have one or more 64-bit words. Level 0 are the fingerprints. A node of a higher level covers a run
    of nodes below and holds `mask`, the bits on which all its fingerprints agree, and `bits`, their values there.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray, fan: int = FAN) -> None:
        n = len(fps)
        fps = fps.reshape(n, -1)
        self.fps = fps
        self.levels = [(fps, np.full_like(fps, ALL), np.arange(n), np.arange(n) + 1)]  # bits, mask, first and last child
        self.last = [np.arange(n)]  # the last fingerprint of each node
        bits, mask, of, last = fps, self.levels[0][1], group, np.arange(n)
        while len(of) and (of[1:] == of[:-1]).any():
            new = np.concatenate([[True], of[1:] != of[:-1]])
            start = np.flatnonzero(new)
            rank = np.arange(len(of)) - np.repeat(start, np.diff(np.concatenate([start, [len(of)]])))
            head = np.flatnonzero(rank % fan == 0)
            same = ~(np.bitwise_or.reduceat(bits ^ np.repeat(bits[head], np.diff(np.concatenate([head, [len(of)]])), axis=0), head, axis=0))
            mask = np.bitwise_and.reduceat(mask, head, axis=0) & same
            end = np.concatenate([head[1:], [len(of)]])
            bits, of, last = bits[head] & mask, of[head], last[end - 1]
            self.levels.append((bits, mask, head, end))
            self.last.append(last)
        self.root = np.searchsorted(of, group)  # each group's node on the top level

    def links(self, limit: int = LIMIT, chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of fingerprints in a group that differ in `limit` bits or fewer."""
        top = len(self.levels) - 1
        stack = []
        for at in range(0, len(self.fps), chunk):
            q = np.arange(at, min(at + chunk, len(self.fps)))
            node = self.root[q]
            d = self._differ(q, node, top, None)
            stack.append((top, *(x[(d <= limit) & (self.last[top][node] > q)] for x in (q, node, d))))
        while stack:
            level, q, node, d = stack.pop()
            if level == 0:
                if len(q):
                    yield q, node
                continue
            if len(q) > chunk:  # half of the frontier at a time bounds memory
                h = len(q) // 2
                stack += [(level, q[:h], node[:h], d[:h]), (level, q[h:], node[h:], d[h:])]
                continue
            _, mask, first, end = self.levels[level]
            size = end[node] - first[node]
            back = np.repeat(np.arange(len(q)), size)
            child = np.arange(len(back)) - np.repeat(np.cumsum(size) - size, size) + first[node][back]
            cq = q[back]
            cd = d[back] + self._differ(cq, child, level - 1, mask[node][back])
            ok = (cd <= limit) & (self.last[level - 1][child] > cq)
            stack.append((level - 1, cq[ok], child[ok], cd[ok]))

    def _differ(self, q: np.ndarray, node: np.ndarray, level: int, known: np.ndarray | None) -> np.ndarray:
        """Differences on the bits that the nodes fix and the nodes above them did not."""
        bits, mask, _, _ = self.levels[level]
        m = mask[node] if known is None else mask[node] & ~known
        return np.bitwise_count((self.fps[q] ^ bits[node]) & m).sum(1, dtype=np.int64)


class Forest:
    """Least member of each set; `up` always points to it."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the sets of all pairs at once: greater roots hang on the least root they meet, until none differ."""
        up = self.up
        while len(a):
            ra, rb = up[a], up[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
            while (nearer := up[up]).tobytes() != up.tobytes():
                up[:] = nearer


def forest_links(group: np.ndarray, fps: np.ndarray, names: np.ndarray, limit: int = LIMIT, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(name, name it hangs on) of a spanning forest of the links in each group.

    All hang on the least name of their component, so that the same texts give the same edges in most of the groups
    in which they meet.
    """
    fps = fps.reshape(len(fps), -1)
    order = gray_order(fps, group)
    tree, forest = GrayTree(fps[order], group[order]), Forest(len(fps))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for found in tree.links(limit):
        pairs.append(found)
        waiting += len(found[0])
        if waiting >= held:
            forest.join(*map(np.concatenate, zip(*pairs, strict=True)))
            pairs, waiting = [], 0
    if pairs:
        forest.join(*map(np.concatenate, zip(*pairs, strict=True)))
    own = names[order]
    least = own.copy()
    np.minimum.at(least, forest.up, own)
    top = least[forest.up]
    return own[own != top], top[own != top]


# the upper nodes


def blocks(free: list[int]) -> list[list[int]]:
    """Three runs of the free bit places (0 is the highest bit)."""
    n = len(free)
    return [free[n * k // 3 : n * (k + 1) // 3] for k in range(3)]


def mask_of(places: list[int]) -> int:
    return signed(sum(1 << 63 - p for p in places))


def _leaf_edges(rows: DataFrame) -> DataFrame:
    """Spanning forests of the leaves: rows (mask, bits, fp), a leaf being a (mask, bits)."""
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(x: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[False], (x[1:, :2] != x[:-1, :2]).any(1)])
            a, b = forest_links(np.cumsum(new), np.ascontiguousarray(x[:, 2]).view(np.uint64), x[:, 2])
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b)], names=["a", "b"])

        rows_held, enough = 0, LEAF
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            held.append(x)
            rows_held += len(x)
            if rows_held >= enough:  # whole leaves go, the last one may go on
                x = np.concatenate(held)
                same = (x[:, :2] == x[-1, :2]).all(1)
                k = len(x) - int(np.argmin(same[::-1])) if not same.all() else 0
                if k:
                    yield links(x[:k])
                held, rows_held = [x[k:].copy()], len(x) - k
                enough = max(LEAF, 2 * rows_held)
        if held and (x := np.concatenate(held)).size:
            yield links(x)

    return rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(run, schema)


def linked(distinct: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within LIMIT bits. `distinct`: one row per value of fp.

    Leaves of up to `leaf` fingerprints go to tasks; larger nodes are refined, three levels deep at most, when
    about 45 of 64 bits are fixed (a third of what is free at each level), so that a node holds 2**19 values at most.
    """
    edges, nodes = [], distinct.select("fp")
    plans: list[tuple[int, list[int]]] = [(0, list(range(64)))]
    for level in range(3):
        made, ahead = [], []
        for up, free in plans:
            for block in blocks(free):
                mask = signed((up | mask_of(block)) & ALL)
                made.append(F.struct(F.lit(mask).alias("mask"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits"), F.lit(up).alias("up")))
                ahead.append((mask, [p for p in free if p not in block]))
        kids = F.explode(F.filter(F.array(*made), lambda s: s["up"] == F.col("mask"))) if level else F.explode(F.array(*made))
        spread = nodes.select("fp", kids.alias("kid")).select("kid.mask", "kid.bits", "fp")
        sizes = spread.groupBy("mask", "bits").agg(F.count("*").alias("n"))
        if level == 2:
            edges.append(_leaf_edges(spread))
            break
        large = cut(sizes.where(F.col("n") > leaf))
        if large.isEmpty():
            edges.append(_leaf_edges(spread))
            break
        edges.append(_leaf_edges(spread.join(large, ["mask", "bits"], "left_anti")))
        nodes = cut(spread.join(large, ["mask", "bits"], "left_semi").select("mask", "bits", "fp"))
        plans = ahead
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


# connected components


def contracted(edges: DataFrame, held: int = 1 << 20) -> DataFrame:
    """Fewer edges (a > b) with the same components: all edges of a node meet in a task, which leaves one for each node that is not the least it knows.

    A task holds `held` edges at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(parts: list[np.ndarray]) -> pa.RecordBatch:
            nodes, at = np.unique(np.concatenate(parts), return_inverse=True)
            at, forest = at.reshape(-1, 2), Forest(len(nodes))
            forest.join(at[:, 0], at[:, 1])
            top = nodes[forest.up]  # nodes are in order: the least place is the least node
            return pa.RecordBatch.from_arrays([pa.array(x[nodes != top], pa.int64()) for x in (nodes, top)], names=["a", "b"])

        waiting, rows = [], 0
        for batch in batches:
            waiting.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            rows += batch.num_rows
            if rows >= held:
                yield settle(waiting)
                waiting, rows = [], 0
        if rows:
            yield settle(waiting)

    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    return ordered.repartition("a").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes with an edge.

    Edges are contracted within tasks first. Then alternates large-star and small-star steps, with map-side minima, until the edges stand still; each round
    is cut from its lineage by a checkpoint in the shared folder.
    """

    def stars(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a")
        if small:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = cut(contracted(edges).distinct())
    seen = state(now)
    for _ in range(rounds):
        now = cut(stars(stars(now, False), True))
        if (is_now := state(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = is_now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _classes(docs: DataFrame, doc_id: str, text: str, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, fp) of each row, mark being a hash of its text; and (fp, least) with the least row of fp's component.

    `least` is a struct (whether the id is null, id, mark), so that null ids come last.
    """
    made = text_function(lambda t: (signed(fingerprint(t)),), "fp long", docs.sparkSession)(F.col(text))["fp"]
    own = cut(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), made.alias("fp")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")
    distinct = cut(own.groupBy("fp").agg(least))
    roots = components(linked(distinct.select("fp"), leaf))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("least"))
    return own, cut(placed.select("fp", "root").join(named, "root").select("fp", "least"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits) and component_id, the least id reachable by links.

    Null and empty texts have fingerprint zero and are linked like others. A component whose ids are all null
    has a null component_id. Repeated rows give repeated results; other columns are not read.
    """
    own, of = _classes(docs, doc_id, text, leaf)
    return own.join(of, "fp").select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row of each component, that with the least id (null ids last; then by a hash of the text); columns as in `docs`.

    Of rows that repeat both, one stays.
    """
    return keep_least(docs, _classes(docs, doc_id, text, leaf)[1], doc_id, text)


def keep_least(docs: DataFrame, of: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `of.least` names (see _classes), each once."""
    kept = of.select("least").distinct().select(*(F.col(f"least.{c}").alias(f"_{c}") for c in ("none", "mark")), F.coalesce("least.doc_id", F.lit(0).cast(docs.schema[doc_id].dataType)).alias("_id"))
    keyed = docs.withColumns({"_none": F.col(doc_id).isNull(), "_mark": F.xxhash64(F.col(text)), "_id": F.coalesce(F.col(doc_id), F.lit(0).cast(docs.schema[doc_id].dataType))})
    keys = ["_none", "_mark", "_id"]
    rows = keyed.join(kept, keys, "left_semi")
    if rows.groupBy(*keys).count().where("count > 1").isEmpty():  # read without texts; only true repeats make whole rows move
        return rows.select(*docs.columns)
    return rows.dropDuplicates(keys).select(*docs.columns)
