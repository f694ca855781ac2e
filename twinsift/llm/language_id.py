"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier for each bit (logistic regression on hashed byte
n-grams) predicts that bit; loss-weighted decoding chooses the language whose codeword has the least summed
loss, and the gap to the next one tells whether the text is ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, batch_function, least_ids, remainder, texts_of

LETTER = regex.compile(r"\p{L}")
#: Hash buckets of byte 2- and 3-grams.
BUCKETS = 1 << 13
#: Ids of the training sample, shared equally among the languages (LEAST for each at least), and the languages that are learned: the most frequent ones.
SAMPLE, LEAST, CLASSES = 1200, 40, 512
#: Characters of a training text.
CHARS = 4096
SCHEMA = "lang_pred string, score double, ambiguous boolean, runner_up string"


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1: all splits for up to 5 classes, else random columns; the best spread of 50 draws."""
    if k <= 5:
        n = max(1, 2 ** (k - 1) - 1)
        return np.array([[1] * n] + [[1 if (c >> j) & 1 else -1 for c in range(n)] for j in range(k - 1)], dtype=np.float64)[:k]
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], size=(k, bits))
        gap = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i)) if k <= 64 else int((m[:1] != m[1:]).sum(1).min())
        if best is None or gap > best[0]:
            best = (gap, m)
    return best[1]


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of the hashed byte 2- and 3-grams, a row of unit length for each text."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer(f" {ascii_lower(text)} ".encode(), dtype=np.uint8)
        for at in range(0, len(b), 1 << 20):  # pieces bound the memory of very long texts; they overlap by a 3-gram
            x = b[at : at + (1 << 20) + 2].astype(np.uint32)
            two = x[:-1] * np.uint32(257) + x[1:]
            row += np.bincount((two * np.uint32(2654435761)) >> np.uint32(19), minlength=BUCKETS)
            if len(x) > 2:
                row += np.bincount(((two[:-1] * np.uint32(263) + x[2:]) * np.uint32(2246822519)) >> np.uint32(19), minlength=BUCKETS)
        row /= max(1.0, row.sum())
    return np.sqrt(out, out=out)


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray  # class by bit
    weights: np.ndarray  # bucket by bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    margin: float = 0.2

    def predict(self, texts: list[str]) -> dict:
        z = features(texts) @ self.weights + self.bias
        loss = np.logaddexp(0, -z[:, None, :] * self.codes[None]) @ self.trust  # text by class
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(texts))
        first, second = p[rows, order[:, 0]], p[rows, order[:, min(1, len(self.langs) - 1)]]
        said = [bool(LETTER.search(t)) for t in texts]
        return {
            "lang_pred": [self.langs[i] if ok else "und" for i, ok in zip(order[:, 0], said, strict=True)],
            "score": [float(x) if ok else 0.0 for x, ok in zip(first, said, strict=True)],
            "ambiguous": [bool(not ok or len(self.langs) > 1 and a - b < self.margin) for a, b, ok in zip(first, second, said, strict=True)],
            "runner_up": [self.langs[i] if ok and len(self.langs) > 1 else None for i, ok in zip(order[:, min(1, len(self.langs) - 1)], said, strict=True)],
        }


def fit(rows: list[tuple[str, str]], steps: int = 120, decay: float = 1e-5, seed: int = 7) -> LanguageModel:
    """One classifier per bit, all bits together, by full-batch Adam on texts and on pieces of them (short texts count)."""
    texts, langs, rng = [], [], np.random.default_rng(seed)
    for text, lang in rows:
        words = text.split()
        for n in sorted({len(words), 12, 3}):
            if 0 < n <= len(words):
                at = int(rng.integers(0, len(words) - n + 1))
                texts.append(" ".join(words[at : at + n])), langs.append(lang)
    names = sorted(set(langs))
    if not names:
        return LanguageModel(["und"], np.ones((1, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    codes = codewords(len(names), seed)
    x = features(texts)
    y = (codes[[names.index(v) for v in langs]] + 1) / 2
    share = np.bincount([names.index(v) for v in langs]) / len(langs)
    each = (1 / share / len(names))[[names.index(v) for v in langs]][:, None] / len(langs)  # languages weigh alike
    w, b = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        off = (1 / (1 + np.exp(-(x @ w + b))) - y) * each
        for v, g, m, s in ((w, x.T @ off.astype(np.float32) + decay * w, *state[:2]), (b, off.sum(0), *state[2:])):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    right = ((x @ w + b > 0) == (y > 0.5)).mean(0)
    trust = np.log(np.clip(right, 0.55, 0.999) / (1 - np.clip(right, 0.55, 0.999)))
    return LanguageModel(names, codes, w, b, trust / trust.sum() * codes.shape[1])


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SAMPLE, seed: int = 7) -> LanguageModel:
    """Fits on a bounded sample of the rows with an id, a text and a language outside the held-out fold.

    Each of the CLASSES most frequent languages has the same number of ids, so a rare one is learned as well; a rarer
    one than those is not learned and never predicted. Of a text a stretch of CHARS characters counts.
    """
    free = docs.where((remainder(F.col(doc_id), 4) != 2) & F.col(lang).isNotNull()).select(doc_id, F.col(lang).alias("_lang"))
    langs = [r[0] for r in free.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(CLASSES).collect()]
    each = max(LEAST, -(-size // max(1, len(langs))))
    return fit(texts_of(docs, least_ids(free, doc_id, "_lang", dict.fromkeys(langs, each), seed), "string", doc_id, text, CHARS), seed=seed)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fold, language, its decoded share, ambiguity and the next language.

    A text that is null, empty or without a letter is `und` with score 0, ambiguous. A null id is in no
    fold (held_out false) and is never learned from. Repeated rows give repeated results; ties between
    codewords go to the first language in order. Nothing is shuffled.
    """
    said = batch_function(model.predict, SCHEMA, docs.sparkSession)(F.col(text))
    out = docs.select(F.col(doc_id), F.coalesce(remainder(F.col(doc_id), 4) == 2, F.lit(False)).alias("held_out"), said.alias("_lang"))
    return out.select(doc_id, "held_out", "_lang.*")
