"""Small tables with all that may go wrong in them."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what the operators add or use inside.
CLASHING = {"score": "x", "predicted": "x", "labels": "x", "fp": "x", "fingerprint": "x", "size": "x", "s": "x", "row": "x", "words": "x", "lines": "x", "ids": "x", "held_out": "x", "_id": "x", "_text": "x", "mark": "x", "kept": "x", "taken": "x", "lang_pred": "x", "feature": "x"}


def odd_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with null columns, empty and very long texts, repeated rows and odd characters."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "and", "über", "naïve", "a", "1984", "#", "stop.", "!!"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60))) + rng.choice(["", "\n", "\n\nend", " \t"]), rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), 5) for i in range(n)]
    rows += [
        (100, None, "en", "s0", None), (101, "", "en", "s1", 0), (102, " \n\t ", None, None, 3), (103, "日本語 текст 🙂\x00 end\u2028x\u00a0y", "en", "s0", 9),
        (None, "without an id", "en", "s0", 3), (None, None, None, None, None), (104, "tie " * 30, "en", "s2", 1), (104, "tie " * 30, "en", "s2", 1), (104, "tie but other text", "en", "s2", 1),
        (105, " ".join(rng.choices(words, k=400_000)), "en", "s0", 1), (106, "x" * 1_500_000, "en", "s1", 1), (107, "line\n" * 50_000, "en", "s1", 1),
    ]
    return rows


def odd_docs(spark, n: int = 60):
    return spark.createDataFrame(odd_rows(n=n), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(docs, *leave):
    from pyspark.sql import functions as F

    return docs.withColumns({k: F.lit(v) for k, v in CLASHING.items() if k not in docs.columns and k not in leave})


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def table(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)
