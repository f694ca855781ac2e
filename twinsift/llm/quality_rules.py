"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Counts of the contract are computed once for each text. The method's own rules follow as one CASE expression,
which stops at the first rule that rejects. Their order is estimated on a bounded sample, in one pass: each rule's
cost is the work counted there (characters that its patterns look at, words and lines that it touches, by weights
stated with it), its selectivity the share it rejects, and rules go by rejection per cost. So the order is the same at
each run; it changes only the time: a document is kept if no rule rejects it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space and symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Rows, about, of the sample on which rules are ordered.
SAMPLE = 2000


@dataclass(frozen=True)
class Rule:
    """`rejects` is a condition on text, words, lines and the counts; null means that it does not reject. `work`: its cost for a text, in characters passed by a pattern."""

    name: str
    rejects: Callable[[], Column]
    work: Callable[[], Column] = lambda: F.lit(1)


def _chars(weight: float) -> Callable[[], Column]:
    return lambda: weight * F.length("text")


def _letters() -> Column:
    return F.regexp_count("text", F.lit(r"\p{L}"))


RULES = (
    Rule("word length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("symbols", lambda: 5 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated lines", lambda: (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.size("lines"))),
    Rule("letters", lambda: 2 * _letters() < F.col("word_chars"), _chars(4)),
    Rule("capitals", lambda: 2 * F.regexp_count("text", F.lit(r"\p{Lu}")) > F.col("word_chars"), _chars(1.5)),
    Rule("shouting", lambda: 5 * F.regexp_count("text", F.lit(r"!!")) > F.col("n_words"), _chars(1)),
    Rule("bullets", lambda: F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))) * 10 > 9 * F.size("lines"), lambda: 30 * F.size("lines")),
    Rule("ellipses", lambda: F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) * 10 > 3 * F.size("lines"), _chars(1.2)),
    Rule("distinct words", lambda: F.size(F.array_distinct("words")) * 20 < F.least("n_words", F.lit(2000)), lambda: 20 * F.col("n_words")),
)


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, words, lines (with a word) and the contract's counts of each row.

    `n_words` depends, in form only, on the partition's number: a filter on the counts would otherwise be pushed
    below them with all their steps written out inside it, to be computed anew for each word.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = own.select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    window = F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    hashed = split.select("*", n.cast("long").alias("n_words"), window.alias("windows"))
    # windows found twice: equal neighbours in order of (hash, place); texts whose windows all differ are not sorted
    sorted_ = hashed.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("pairs"))
    twice = F.filter("pairs", lambda x, i: (x["h"] == F.get("pairs", i - 1)["h"]) | (x["h"] == F.get("pairs", i + 1)["h"]))
    placed = sorted_.select("doc_id", "text", "words", "lines", "n_words", F.transform(twice, lambda x: x["i"]).alias("at"))
    covered = F.array_distinct(F.concat("at", F.transform("at", lambda p: p + 1), F.transform("at", lambda p: p + 2)))
    return placed.select(
        "doc_id", "text", "words", "lines",
        F.when(F.spark_partition_id() >= 0, F.col("n_words")).alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, size: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> list[tuple[Rule, float, float]]:
    """The rules by rejection per cost, with (mean work on a text, share rejected).

    One job over a share of all rows (about `size` of them); texts that fail the base are left out, as no rule sees them.
    Without rows the rules keep their order. Only sums leave the tasks.
    """
    share = min(1.0, size / max(1, docs.count()))
    rows = counts(docs.select(F.col(doc_id), F.col(text)).sample(share, seed=1), doc_id, text).where(~base_failed())
    sums = []
    for k, rule in enumerate(rules):
        sums += [F.count_if(F.coalesce(rule.rejects(), F.lit(False))).alias(f"rejected_{k}"), F.sum(rule.work().cast("double")).alias(f"work_{k}")]
    got = rows.agg(F.count("*").alias("n"), *sums).first()
    n = max(1, got["n"])
    found = [(rule, max(1.0, (got[f"work_{k}"] or 0.0) / n), got[f"rejected_{k}"] / n) for k, rule in enumerate(rules)]
    return sorted(found, key=lambda x: -x[2] / x[1])


def judge(docs: DataFrame, rules: tuple[Rule, ...] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, the counts, base_failed and kept.

    A null or empty text has no words and fails the base. Repeated rows give repeated results; other columns
    are not read. Three words count as found twice if their 64-bit hashes are equal. Nothing is shuffled.
    """
    if rules is None:
        rules = tuple(r for r, _, _ in ordered(docs, doc_id=doc_id, text=text))
    verdict = F.when(base_failed(), False)
    for rule in rules:
        verdict = verdict.when(rule.rejects(), False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return counts(docs, doc_id, text).select(F.col("doc_id").alias(doc_id), *names, base_failed().alias("base_failed"), verdict.otherwise(True).alias("kept"))


#: The counts and the verdict in DuckDB.
SQL = r"""
WITH held AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM held
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n FROM places
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r
), counted AS (
  SELECT doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM held LEFT JOIN covered c USING (r)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (
  base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 5 * n_symbols > n_words
  OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * len(lines))
  OR 2 * len(regexp_extract_all(text, '\p{L}')) < word_chars OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > word_chars
  OR 5 * len(regexp_extract_all(text, '!!')) > n_words
  OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) > 9 * len(lines)
  OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 3 * len(lines)
  OR 20 * len(list_distinct(words)) < least(n_words, 2000)) AS kept
FROM failed
"""
