"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good (1) or bad (0). State features describe a line and its two neighbours; transition
weights tie neighbours' labels. Training documents lend their label to all their lines; the weights maximise
the regularised likelihood of those label sequences (forward-backward gradients). A document's score is the
mean of its lines' forward-backward marginals, weighted by their lengths.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_function, labelled, remainder, slices

#: Bounds of the labelled sample: ids labelled 0 and 1.
SAMPLE = (1500, 3500)
SCHEMA = "score double, predicted int, n_lines long, bad_lines long"

_MIX = np.random.default_rng(11).integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)


def _kinds() -> np.ndarray:
    """For each byte the class that it counts in."""
    k = np.full(256, 7, dtype=np.uint8)  # other punctuation
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"#*$%&|<>", b"!?", b".,;:")):
        k[list(chars)] = i
    k[0x80:] = 8
    k[10] = 9
    return k


KINDS = _kinds()
#: Features of one line.
NAMES = ("length", "lower", "upper", "digit", "space", "symbol", "shout", "stop", "other", "beyond ascii", "word length", "words", "repeated word", "repeated line", "empty")


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[ends] - c[starts]


def _block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (all but repeated lines), lengths, hashes and word counts of the lines of UTF-8 bytes."""
    breaks = np.flatnonzero(b == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(b)]])
    kind = KINDS[b]
    length = ends - starts
    by = np.maximum(length, 1)
    share = [np.sqrt(_sums(kind == k, starts, ends) / by) for k in range(9)]
    # words: runs without white space, hashed by bytes and places
    solid = (kind != 3) & (kind != 9)
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    w0 = np.flatnonzero(edge == 1)
    first, last = np.searchsorted(w0, starts), np.searchsorted(w0, ends)
    n_words = last - first
    hashes = np.zeros(0, np.uint64)
    if len(w0):
        place = (np.arange(len(b)) - np.repeat(np.concatenate([[0], w0]), np.diff(np.concatenate([[0], w0, [len(b)]])))) & 255
        hashes = np.add.reduceat(np.where(solid, _MIX[0][b] * _MIX[1][place], np.uint64(0)), w0)
    again = np.zeros(len(w0), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[n_words > 0]] = False
    repeated = _sums(again, first, last) / np.maximum(n_words, 1)
    spot = _MIX[0][(np.arange(len(hashes)) - np.repeat(first, n_words)) & 255]
    whole = np.concatenate([[np.uint64(0)], np.cumsum(hashes * spot, dtype=np.uint64)])
    mark = (whole[last] - whole[first]) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64)
    columns = [np.log1p(length), *share, _sums(solid, starts, ends) / np.maximum(n_words, 1) / 10, np.log1p(n_words), repeated, np.zeros(len(mark)), (n_words == 0) * 1.0]
    return np.stack(columns, 1), length, mark, n_words


def line_features(texts: list[str], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the number of lines of each text, and the lines' lengths in bytes.

    Bytes are worked on in blocks of about `limit` that end at a line's end, so memory follows the longest line.
    """
    counts = np.array([t.count("\n") + 1 for t in texts])
    b, at, parts = "\n".join(texts).encode(), 0, []
    while len(b) - at > limit and (end := b.find(b"\n", at + limit)) >= 0:
        parts.append(_block(np.frombuffer(b, np.uint8, end - at, at)))
        at = end + 1
    parts.append(_block(np.frombuffer(b, np.uint8, len(b) - at, at)))
    f, length, mark, n_words = (np.concatenate(x) for x in zip(*parts, strict=True))
    # lines equal to an earlier one of their text
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((np.arange(len(mark)), mark, owner))
    same = (mark[order][1:] == mark[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (n_words[order][1:] > 0)
    f[order[1:][same], NAMES.index("repeated line")] = 1
    return f, counts, length


def states(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, the line before and the line after (zeros beyond a text's ends)."""
    f, counts, length = line_features(texts)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    before[starts] = 0
    after[starts + counts - 1] = 0
    return np.concatenate([f, before, after], 1), counts, length


class LineField:
    """Weights of the field: state weights for label 1 against 0, and log transitions [from, to]."""

    def __init__(self, mean, scale, w, b: float, t: np.ndarray) -> None:
        self.mean, self.scale, self.w, self.b, self.t = mean, scale, w, b, t

    def marginals(self, u: list[float]) -> list[float]:
        """P(label 1) of each line by forward-backward; u: log potentials of label 1 against 0."""
        (t00, t01), (t10, t11) = np.exp(self.t).tolist()
        e = [math.exp(min(30.0, max(-30.0, x))) for x in u]
        ahead = []
        a0, a1 = 1.0, e[0]
        for i, x in enumerate(e):
            if i:
                a0, a1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * x
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            ahead.append((a0, a1))
        out = [0.0] * len(e)
        b0 = b1 = 1.0
        for i in range(len(e) - 1, -1, -1):
            a0, a1 = ahead[i]
            out[i] = a1 * b1 / (a0 * b0 + a1 * b1)
            x = e[i]
            b0, b1 = t00 * b0 + t01 * x * b1, t10 * b0 + t11 * x * b1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
        return out

    def score(self, texts: list[str]) -> dict:
        x, counts, length = states(texts)
        u = (((x - self.mean) / self.scale) @ self.w + self.b).tolist()
        weight = np.maximum(length, 1).tolist()
        out: dict[str, list] = {"score": [], "predicted": [], "n_lines": [], "bad_lines": []}
        at = 0
        for n in counts.tolist():
            m, w = self.marginals(u[at : at + n]), weight[at : at + n]
            s = min(1.0, max(0.0, sum(a * b for a, b in zip(m, w, strict=True)) / sum(w)))
            for k, v in zip(out, (s, int(s >= 0.5), n, sum(p < 0.5 for p in m)), strict=True):
                out[k].append(v)
            at += n
        return out


def _gradient(u: np.ndarray, real: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of constant label sequences, in u and t. u, real: document by line."""
    docs, n = u.shape
    e = np.stack([np.ones_like(u), np.exp(np.clip(u, -30, 30))], 2)
    e[~real] = 1
    m = np.exp(t)
    a, b = np.empty((docs, n, 2)), np.ones((docs, n, 2))
    for i in range(n):
        a[:, i] = (a[:, i - 1] @ m if i else 1.0) * e[:, i]
        a[:, i] /= a[:, i].sum(1, keepdims=True)
    last = real.sum(1) - 1
    for i in range(n - 2, -1, -1):
        v = (e[:, i + 1] * b[:, i + 1]) @ m.T
        b[:, i] = np.where((i < last)[:, None], v / v.sum(1, keepdims=True), 1.0)
    p = a * b
    p /= p.sum(2, keepdims=True)
    du = np.where(real, y[:, None] - p[:, :, 1], 0)
    dt = np.zeros((2, 2))
    if n > 1:
        pair = a[:, :-1, :, None] * m[None, None] * (e * b)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        both = real[:, 1:]
        dt -= (pair * both[:, :, None, None] / np.maximum(1, real.sum(1))[:, None, None, None]).sum((0, 1))
        steps = both.sum(1) / np.maximum(1, real.sum(1))
        dt[0, 0] += steps[y == 0].sum()
        dt[1, 1] += steps[y == 1].sum()
    return du / np.maximum(1, real.sum(1))[:, None], dt / docs


def fit(rows: list[tuple[str, int]], epochs: int = 40, batch: int = 128, decay: float = 1e-4, most: float = 4.0, seed: int = 3) -> LineField:
    """Adam over batches of documents of like line counts. `most` bounds the log transitions."""
    k = 3 * len(NAMES)
    if len({v for _, v in rows}) < 2:
        return LineField(np.zeros(k), np.ones(k), np.zeros(k), 2.0, np.zeros((2, 2)))
    parts = [states(some)[:2] for some in slices(pa.array([t for t, _ in rows], pa.string()))]  # in slices, for the driver's memory
    x, counts = (np.concatenate(v) for v in zip(*parts, strict=True))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.clip((x - mean) / scale, -8, 8)
    y = np.array([v for _, v in rows])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(counts, kind="stable")
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    w, b, t = np.zeros(k), np.zeros(1), np.zeros((2, 2))
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, b, t)]
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            d = groups[g]
            n = int(counts[d].max())
            real = np.arange(n)[None] < counts[d][:, None]
            at = np.where(real, starts[d][:, None] + np.arange(n)[None], 0)
            du, dt = _gradient(x[at] @ w + b, real, y[d], t)
            share = 1 / len(d)
            step += 1
            for (m, s), v, g_ in zip(state, (w, b, t), (np.einsum("dn,dnk->k", du, x[at]) * share - decay * w, du.sum(keepdims=True)[0] * share, dt - decay * t), strict=True):
                m += 0.1 * (g_ - m)
                s += 0.01 * (g_ * g_ - s)
                v += 0.05 / (1 + 0.1 * epoch) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
            np.clip(t, -most, most, out=t)
    return LineField(mean, scale, w, float(b[0]), t)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sizes: tuple[int, int] = SAMPLE, seed: int = 3) -> LineField:
    return fit(labelled(docs, labels, label, sizes, seed, doc_id, text), seed=seed)


def score_quality(docs: DataFrame, model: LineField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fold, score, prediction, lines and lines more likely bad than good.

    A null or empty text is one empty line and has the score that this gives. A null id is in no fold
    (held_out false). Repeated rows give repeated results. Nothing is shuffled.
    """
    said = batch_function(model.score, SCHEMA, docs.sparkSession)(F.col(text))
    held = F.coalesce(remainder(F.col(doc_id), 3) == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col(doc_id), held, said.alias("_quality")).select(doc_id, "held_out", "_quality.*")


def keep_good(docs: DataFrame, model: LineField, text: str = "text") -> DataFrame:
    """The rows that the field does not reject, with their own columns."""
    said = batch_function(model.score, SCHEMA, docs.sparkSession)(F.col(text))
    return docs.withColumn("_quality", said).where("_quality.predicted = 1").select(*docs.columns)
