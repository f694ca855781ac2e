"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart: one on ordinary text, one on passages of toxic documents. A window of
a text is compressed with the ordinary dictionary alone and with the toxic one in front of it; the difference in
length is what toxic passages explain of the window and ordinary text does not. (Compressed with the toxic
dictionary alone, a window costs more or less by chance, by several bytes, whatever it says: see the README.)

Most of a toxic document is ordinary. So its passages are purified by the same distance: a passage of a few words
stays if a dictionary of other toxic documents shortens it more than it shortens all but a small share of the
passages of ordinary documents that no dictionary has seen. A few rounds of this, with smaller and smaller
dictionaries, leave what toxic documents have in common. Scores come from the differences of a text's windows by a
logistic calibration on labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, labelled, logistic, pieces, remainder, sigmoid, text_function

#: Bounds of the labelled sample: ids labelled 0 and 1.
SAMPLE = (4000, 2000)
#: Bytes of the ordinary dictionary, and of the toxic one in each round (the last is used).
ORDINARY, TOXIC = 80_000, (32_000, 8_000, 2_048, 2_048)
#: Words of a window, of a passage, from one passage to the next, of a stretch that trains the ordinary dictionary, and most characters of a word (longer ones are cut).
WINDOW, PASSAGE, STRIDE, STRETCH, LONGEST = 16, 4, 2, 64, 256
#: Share of ordinary passages that may pass as toxic ones, and the ordinary passages that this is measured on at most.
PASS, REFERENCE = 0.005, 20_000
#: Compression level, shortest match, and the trainer's parameters (segment of the ordinary and the toxic dictionary, d).
LEVEL, MATCH, SEGMENTS, D = 12, 4, (64, 12), 8
#: Orders of the texts that purification is tried with: one may settle on too little of what toxic documents share.
TRIES = 3
#: Differences in bytes from which windows are counted.
STEPS = (1, 2, 3, 4)
SCHEMA = "score double, predicted int, windows long, flagged long, worst int"


def words(text: str) -> Iterator[str]:
    for piece in pieces(text):
        for w in WORD.findall(piece.lower()):
            for at in range(0, len(w), LONGEST):
                yield w[at : at + LONGEST]


def windows(text: str, size: int, step: int | None = None) -> Iterator[bytes]:
    """Runs of `size` words, each `step` words after the one before; a text without words has one empty window."""
    step, run, any_ = step or size, [], False
    for w in words(text):
        run.append(w)
        if len(run) == size:
            yield _bytes(run)
            any_, run = True, run[step:]
    if not any_ or (step == size and run):
        yield _bytes(run)


def _bytes(run: list[str]) -> bytes:
    return f" {' '.join(run)} ".encode()


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=D).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b" "


def compressor(content: bytes):
    """Compresses with the dictionary's content; all dictionaries get the same parameters."""
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=512, dict_size=ORDINARY + max(TOXIC), min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


class Distance:
    """Differences of compressed lengths without and with a toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self.pair = None

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "pair": None}  # compressors are made where they are used

    def gap(self, b: bytes) -> int:
        if self.pair is None:
            self.pair = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        plain, toxic = self.pair
        return len(plain(b)) - len(toxic(b))

    def measure(self, text: str) -> np.ndarray:
        """The differences of the text's windows."""
        return np.array([self.gap(b) for b in windows(text, WINDOW)])

    def statistics(self, text: str) -> list[float]:
        """The greatest difference, the mean of the three greatest, and for each step what goes beyond it, in all and by length; last, the log of the windows."""
        a = self.measure(text)
        n, top = len(a), np.sort(a)[::-1]
        root, over = n**0.5, [int((a >= t).sum()) for t in STEPS]
        return [
            float(top[0]), float(top[:3].mean()), *(float(np.maximum(a - t, 0).sum()) / root for t in STEPS[:3]),
            *(v / root for v in over), *(float(np.log1p(v)) for v in over), float(np.log(n)),
        ]


def purified(ordinary: list[str], toxic: list[str], sizes: tuple[int, ...] = TOXIC) -> list[bytes]:
    """Those passages of toxic documents that other toxic documents explain and ordinary ones do not: what trains the toxic dictionary."""
    base = trained([b for t in ordinary[::2] for b in windows(t, STRETCH)], ORDINARY, SEGMENTS[0])
    unseen = [b for t in ordinary[1::2] for b in windows(t, PASSAGE, STRIDE)]
    unseen = unseen[:: max(1, -(-len(unseen) // REFERENCE))]
    passages = [[b for t in toxic[h::2] for b in windows(t, PASSAGE, STRIDE)] for h in (0, 1)]
    chosen = [[b for t in toxic[h::2] for b in windows(t, WINDOW)] for h in (0, 1)]
    for size in sizes:
        kept: list[list[bytes]] = [[], []]
        for h in (0, 1):
            d = Distance(base, trained(chosen[h], size, SEGMENTS[1]))
            least = max(1.0, float(np.quantile([d.gap(b) for b in unseen] or [0], 1 - PASS)))
            kept[1 - h] = [b for b in passages[1 - h] if d.gap(b) >= least]
        chosen = kept
    return chosen[0] + chosen[1]


def distance(rows: list[tuple[str, int]], seed: int) -> Distance:
    """Both dictionaries, of labelled texts; each text counts once. The passages of TRIES orders of the texts are pooled."""
    rng = np.random.default_rng(seed)
    plain, toxic = (sorted({t for t, v in rows if v == k}) for k in (0, 1))
    whole = trained([b for t in plain for b in windows(t, STRETCH)], ORDINARY, SEGMENTS[0])
    passages = [b for _ in range(TRIES) for b in purified(*([texts[i] for i in rng.permutation(len(texts))] for texts in (plain, toxic)))]
    return Distance(whole, trained(passages, TOXIC[-1], SEGMENTS[1]))


class ToxicityModel:
    def __init__(self, measure: Distance, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float = 0.7) -> None:
        self.measure, self.mean, self.scale, self.weights, self.threshold = measure, mean, scale, weights, threshold

    def score(self, text: str) -> tuple:
        s = self.measure.statistics(text)
        p = float(sigmoid((np.array(s) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]))
        return p, int(p >= self.threshold), int(round(np.exp(s[-1]))), int(round(np.expm1(s[5 + len(STEPS) + 1]))), int(s[0])


def fit(rows: list[tuple[str, int]], seed: int = 5, held: dict[int, int] | None = None) -> ToxicityModel:
    """Trains the dictionaries on two thirds of each label's texts and calibrates on the last third, which they have not seen.

    Equal texts of a label count once, so that no copy is on both sides. `held`: how many rows have each label in all;
    the calibration weighs the sample's labels by it, since a sample takes more of the rare one. Without both labels in
    both parts all scores are low.
    """
    rows = sorted(set(rows))
    order = np.random.default_rng(seed).permutation(len(rows))
    by = [[rows[i] for i in order if rows[i][1] == k] for k in (0, 1)]
    train, rest = [r for some in by for k, r in enumerate(some) if k % 3 < 2], [r for some in by for r in some[2::3]]
    if len({v for _, v in rest}) < 2:
        n = 6 + 2 * len(STEPS)
        return ToxicityModel(Distance(b" ", b" "), np.zeros(n), np.ones(n), np.array([0.0] * n + [-4.0]))
    b = np.array([v for _, v in rest])
    each = np.array([(held or {}).get(k, (b == k).sum()) / (b == k).sum() for k in (0, 1)])[b]
    d = distance(train, seed)
    a = np.array([d.statistics(t) for t, _ in rest])
    mean, scale = a.mean(0), a.std(0) + 1e-9
    return ToxicityModel(d, mean, scale, logistic((a - mean) / scale, b, 1e-3, each=each))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sizes: tuple[int, int] = SAMPLE, seed: int = 5) -> ToxicityModel:
    """Fits on a bounded sample of labelled documents outside the held-out fold; see common.labelled, fit.

    Rows without id, label or text are not learned from; repeated rows count once; of empty tables the model is the one
    that calls nothing toxic. Other columns are not read.
    """
    rows = labelled(docs, labels, label, sizes, seed, doc_id, text)
    free = labels.where(remainder(F.col(doc_id), 3) != 1).groupBy(F.col(label).cast("int").alias("k")).count()
    return fit(rows, seed, {r["k"]: r["count"] for r in free.where("k IN (0, 1)").collect()})


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fold, score, prediction, windows, flagged windows (two bytes or more) and the worst difference.

    A null or empty text has one empty window and the score that this gives. A null id is in no fold
    (held_out false). Repeated rows give repeated results. Nothing is shuffled.
    """
    said = text_function(model.score, SCHEMA, docs.sparkSession)(F.col(text))
    held = F.coalesce(remainder(F.col(doc_id), 3) == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col(doc_id), held, said.alias("_tox")).select(doc_id, "held_out", "_tox.*")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows that the model does not call toxic, with their own columns.

    Null and empty texts are judged as one empty window. Repeated rows stay or go together; an empty table stays empty;
    columns of any names are kept as they are.
    """
    said = text_function(model.score, SCHEMA, docs.sparkSession)(F.col(text))
    return docs.withColumn("_tox", said).where("_tox.predicted = 0").select(*docs.columns)
