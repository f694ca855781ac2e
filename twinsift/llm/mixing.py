"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a mix are cut into slots of equal size, as many as the least Fibonacci number that keeps a slot at
`block` words or fewer. Slot k has the golden-ratio point frac(k * 0.618...), as a 60-bit integer; the sources'
cumulative targets divide that range, and the source in whose span the point falls fills the slot. So the schedule
decides what each source gives: its slots, each of one block. Slots are ranked per source. Each source's documents
are laid out in a shuffled (hashed) order as one line of words, repeated when its slots need more than its size;
the line is cut into blocks of a slot's size, and the slot of rank r takes block r. At a Fibonacci number of slots
a source's count of points differs from its share by less than two, at any other prefix by about log n. All amounts
are integers, so reruns agree on any cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Most words of a slot, times that a document may be taken, sources up to which their table is broadcast.
BLOCK, TIMES, BROADCAST = 32, 3, 10_000
#: The golden ratio's fraction in 60 bits; white space between words.
GOLDEN, RANGE, WORDS = 712544676207699905, 1 << 60, r"[^\x20\x09-\x0D]+"
#: Shuffled orders are summed in so many runs per source, and slots ranked in runs of so many, so that no task holds a whole source.
RUNS, SLOT_RUN = 4096, 1 << 20


def _whole(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _div(a: F.Column, b: F.Column) -> F.Column:
    """The whole part of a / b for whole decimals; the remainder goes first, since a decimal quotient is rounded."""
    return ((a - a % b) / b).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source: s (place in order, null last), weight, source_size, target, take (its whole words) and total.

    Sources share the total by weight; a target stops at TIMES its source's size and the excess goes to the
    others by weight. Taken in the order of size per weight, a source is capped exactly if its cap is at most
    its share of what the sources before it have left.
    """
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    named = sums.withColumn("s", F.row_number().over(order).cast("long")).withColumn("weight", F.element_at(cycle, ((F.col("s") - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "s")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    filled = named.withColumns({
        "total": F.sum("source_size").over(everything),
        "left": F.sum("source_size").over(everything) - F.coalesce(TIMES * F.sum("source_size").over(before), F.lit(0)),
        "rest": F.sum("weight").over(after),
    }).withColumn("capped", _whole(TIMES * F.col("source_size")) * _whole("rest") <= _whole("weight") * _whole("left"))
    free = filled.withColumns({
        "left": F.col("total") - TIMES * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0)),
        "rest": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything),
    })
    target = F.when(F.col("capped"), (TIMES * F.col("source_size")).cast("double")).otherwise(F.col("weight") * (F.col("left").cast("double") / F.col("rest").cast("double")))
    take = F.when(F.col("capped"), TIMES * F.col("source_size")).otherwise(_div(_whole("weight") * _whole("left"), _whole("rest")))
    return cut(free.select("source", "s", "weight", "source_size", target.alias("target"), take.alias("take"), "total"))


def slots_for(words: int, block: int = BLOCK) -> int:
    """Slots of a mix of so many words: the least Fibonacci number that keeps a slot at `block` words or fewer."""
    a, b = 1, 2
    while a * block < words:
        a, b = b, a + b
    return a if words else 0


def schedule(mix: DataFrame, slots: int, golden: int = GOLDEN) -> DataFrame:
    """The slots whose point falls to a source: slot, s and rank (among the source's slots). `mix`: s and take."""
    spark = mix.sparkSession
    total, sources = mix.agg(F.coalesce(F.sum("take"), F.lit(0)), F.count("*")).first()
    upto = F.sum("take").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    bound = lambda c: _div(_whole(c) * _whole(F.lit(RANGE)), _whole(F.lit(max(1, int(total)))))
    spans = mix.where("take > 0").select("s", bound(upto - F.col("take")).alias("low"), bound(upto).alias("high")).where("low < high")
    cell = RANGE >> max(12, int(sources).bit_length() + 4)  # points and spans meet in cells, then by comparison
    celled = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    point = (F.col("id").cast("decimal(19,0)") * F.lit(golden).cast("decimal(19,0)")) % _whole(F.lit(RANGE))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.cast("long").alias("point")).withColumn("cell", F.floor(F.col("point") / cell))
    hit = points.join(celled, "cell").where("point >= low AND point < high").select("slot", "s", F.floor(F.col("slot") / SLOT_RUN).alias("slots"))
    ahead = Window.partitionBy("s").orderBy("slots").rowsBetween(Window.unboundedPreceding, -1)
    runs = hit.groupBy("s", "slots").agg(F.count("*").alias("n")).select("s", "slots", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    here = F.row_number().over(Window.partitionBy("s", "slots").orderBy("slot"))
    return hit.withColumn("here", here - 1).join(runs, ["s", "slots"]).select("slot", "s", (F.col("ahead") + F.col("here")).alias("rank"))


def layout(docs: DataFrame, doc_id: str, source: str, text: str, seed: int) -> DataFrame:
    """doc_id, source, size, run and key of each row: the key's order is the shuffled order of a source."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key")).withColumn("run", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, seed: int = 17, golden: int = GOLDEN) -> tuple[DataFrame, DataFrame]:
    """(blocks, rows). blocks: slot, s, rank, run, row, copy, pass, doc_id, words, start: what each slot takes from which row, from its word `start`.

    rows: one per row of `docs`, named by s, run, row and copy (among rows alike), with doc_id, size, source_size,
    target, taken (words) and whole (passes of the line in which half of its words or more are taken). A null text has
    no words and nothing of it is taken; a null source is a source of its own; documents without an id lie where the
    empty id hashes to. Rows that agree in id and size are exchangeable.
    """
    alike = layout(docs, doc_id, source, text, seed).groupBy("doc_id", "source", "size", "key", "run").agg(F.count("*").alias("m"))
    sized = cut(alike.withColumn("held", F.col("size") * F.col("m")))  # rows alike are one until their places are known
    goal = targets(sized.select("source", F.col("held").alias("size")), weights)
    sources, words = goal.agg(F.count("*"), F.coalesce(F.sum("take"), F.lit(0))).first()
    small = (lambda x: F.broadcast(x)) if sources <= BROADCAST else (lambda x: x)
    total, n = max(1, int(words)), slots_for(int(words), block)
    slot = cut(schedule(goal, n, golden))
    counts = cut(goal.join(slot.groupBy("s").agg(F.count("*").alias("n")), "s", "left").select("s", "source", "source_size", "target", F.coalesce("n", F.lit(0)).alias("n")))
    runs = sized.groupBy("source", "run").agg(F.sum("held").alias("run_size")).withColumnRenamed("source", "_source")
    runs = runs.join(small(counts), F.col("_source").eqNullSafe(F.col("source"))).drop("_source", "source")
    ahead = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("ahead", F.coalesce(F.sum("run_size").over(ahead), F.lit(0))).select("s", "run", "ahead")
    placed = sized.withColumnRenamed("source", "_source").join(small(counts), F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    in_run = Window.partitionBy("s", "run").orderBy("key", "doc_id", "size")
    placed = placed.withColumns({"row": F.row_number().over(in_run), "start": F.sum("held").over(in_run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")})
    placed = placed.join(runs, ["s", "run"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    placed = placed.withColumn("at", F.col("start") + F.col("ahead") + F.col("copy") * F.col("size"))
    rows = cut(placed.select("s", "run", "row", "copy", "doc_id", "source", "size", "source_size", "target", "n", "at"))
    times = rows.where("size > 0 AND n > 0").withColumn("pass", F.explode(F.array(*(F.lit(p).cast("long") for p in range(TIMES)))))
    low = F.col("pass") * F.col("source_size") + F.col("at")
    of_word = lambda t: _div(_whole(t + 1) * _whole(F.lit(n)) - 1, _whole(F.lit(total)))  # noqa: E731  the block of the word t on the line
    edge = lambda r: _div(_whole(r) * _whole(F.lit(total)), _whole(F.lit(max(1, n))))  # noqa: E731  the first word of block r
    spans = times.withColumns({"low": low, "high": F.least(low + F.col("size"), edge(F.col("n")))}).where("low < high")
    cutup = spans.withColumn("rank", F.explode(F.sequence(of_word(F.col("low")), of_word(F.col("high") - 1))))
    first, last = F.greatest("low", edge(F.col("rank"))), F.least("high", edge(F.col("rank") + 1))
    parts = cutup.select("s", "run", "row", "copy", "pass", "doc_id", "size", F.col("rank"), (last - first).alias("words"), (first - F.col("low")).alias("start"))
    blocks = parts.join(slot, ["s", "rank"])
    passes = blocks.groupBy("s", "run", "row", "copy", "pass", "size").agg(F.sum("words").alias("words"))
    taken = passes.groupBy("s", "run", "row", "copy").agg(F.sum("words").alias("taken"), F.sum((2 * F.col("words") >= F.col("size")).cast("long")).alias("whole"))
    rows = rows.join(taken, ["s", "run", "row", "copy"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("taken", "whole")})
    return blocks.select("slot", "s", "rank", "run", "row", "copy", "pass", "doc_id", "words", "start"), rows


def mix_amounts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, seed: int = 17, golden: int = GOLDEN) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target and taken; see mix."""
    _, rows = mix(docs, doc_id, source, text, weights, block, seed, golden)
    return rows.select(F.col("doc_id").alias(doc_id), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The documents as often as their blocks are taken, rounded to whole documents; columns as in `docs`.

    A document comes once for each pass of its source's line in which slots take half of its words or more, so a
    source's words differ from its slots' by half a document. Rows that agree in id, source and size share what falls
    to all of them as evenly as it divides. Rows without words stay out.
    """
    amounts = mix(docs, doc_id, source, text, weights, block, seed)[1].where("size > 0")
    keys = {"_id": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "_null": F.col(doc_id).isNull(), "_none": F.col(source).isNull(), "_source": F.coalesce(source, F.lit("")), "_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")}
    per = amounts.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), F.col("size").alias("_size"))
    whole = F.sum("whole")  # copies of all rows alike together
    copies = cut(per.agg(F.floor(whole / F.count("*")).cast("int").alias("_copies"), (whole % F.count("*")).alias("_more")).where("_copies > 0 OR _more > 0"))
    joined = docs.withColumns(keys).join(copies.where("_more = 0"), list(keys))
    if not (uneven := copies.where("_more > 0")).isEmpty():
        joined = joined.unionByName(_one_more(docs.withColumns(keys).join(uneven, list(keys)), list(keys), text))
    return joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def _one_more(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The rows, of which in each group the first `_more` get one copy more. They are numbered in runs by a hash of the text, so that no task holds a whole group."""
    run = F.pmod(F.xxhash64(F.col(text)), F.lit(RUNS))
    sizes = rows.groupBy(*keys, run.alias("_run")).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    placed = rows.withColumn("_run", run).join(runs, [*keys, "_run"])
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(F.xxhash64(F.col(text))))
    return placed.withColumn("_copies", F.col("_copies") + (place <= F.col("_more")).cast("int")).drop("_run", "_ahead")


#: The contract's amounts in DuckDB, schedule included. Blocks of a source follow one another, so its slots together take a beginning of its repeated line.
SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s
  FROM sized GROUP BY source
), named AS (
  SELECT *, (s - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM sums
), filled AS (
  SELECT *, 3 * source_size * sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= weight * (total - coalesce(3 * sum(source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped
  FROM named
), free AS (
  SELECT *, total - 3 * coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0) AS rest_words,
         sum(CASE WHEN NOT capped THEN weight END) OVER () AS rest_weight
  FROM filled
), goals AS (
  SELECT source, s, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE weight * (CAST(rest_words AS DOUBLE) / CAST(rest_weight AS DOUBLE)) END AS target,
         CASE WHEN capped THEN 3 * source_size ELSE weight * rest_words // rest_weight END AS take
  FROM free
), whole AS (
  SELECT CAST(coalesce(sum(take), 0) AS HUGEINT) AS words FROM goals
), fibonacci AS (
  SELECT CAST(1 AS HUGEINT) AS a, CAST(2 AS HUGEINT) AS b
  UNION ALL
  SELECT b, a + b FROM fibonacci, whole WHERE a * 32 < words
), counted AS (
  SELECT words, CASE WHEN words > 0 THEN (SELECT max(a) FROM fibonacci) ELSE 0 END AS n FROM whole
), slots AS (
  SELECT CAST(k AS HUGEINT) * 712544676207699905 % 1152921504606846976 AS point
  FROM (SELECT unnest(range(CAST(n AS BIGINT))) AS k FROM counted)
), spans AS (
  SELECT s, (sum(take) OVER by_name - take) * CAST(1152921504606846976 AS HUGEINT) // words AS low,
         sum(take) OVER by_name * CAST(1152921504606846976 AS HUGEINT) // words AS high
  FROM (SELECT s, CAST(take AS HUGEINT) AS take FROM goals), counted WHERE words > 0
  WINDOW by_name AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), given AS (
  SELECT s, count(*) AS slots FROM slots JOIN spans ON point >= low AND point < high GROUP BY s
), gives AS (
  SELECT g.source, g.source_size, g.target, CASE WHEN n > 0 THEN coalesce(slots, 0) * words // n ELSE 0 END AS take
  FROM goals g CROSS JOIN counted LEFT JOIN given ON given.s = g.s
), placed AS (
  SELECT doc_id, size, source_size, target, take,
         sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place
  FROM sized z JOIN gives g ON z.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(greatest(0, least(take, place + size) - place)
          + greatest(0, least(take, source_size + place + size) - source_size - place)
          + greatest(0, least(take, 2 * source_size + place + size) - 2 * source_size - place) AS BIGINT) AS taken
FROM placed
"""
