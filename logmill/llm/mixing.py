"""Mixing sources to target weights, by histograms over hash thresholds.

A source's budget of words is met by taking all documents as often as it fits and, once
more, those whose hash lies below a threshold. The threshold is found from the words in
each hash bucket: the bucket in which the budget ends is looked into with finer buckets,
its rows alone, until one document is left. No document is sorted, and a larger budget
takes all that a smaller one does, for hashes do not depend on it.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmill.llm.common import read_table, stored
from logmill.llm.ranking import ranked

WEIGHTS = (1, 2, 3)
# A document is taken at most so often.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
# A hash has 60 bits; a histogram looks at 12 more of them each round.
_BITS, _DIGIT = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(key: Column, text: Column) -> Column:
    """60 bits of a hash of key and text."""
    spelled = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(spelled), 1, _BITS // 4), 16, 10).cast("bigint")


def weighed(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``source``, ``words`` with ``weight``: ``weights`` over and over, by name, NULL last."""
    rows = sources.select("source", "words", F.lit(0).alias("all"))
    rows = ranked(rows, "all", [F.col("source").isNull(), F.col("source")], "sources")
    cycle = F.array(*map(F.lit, weights))
    return rows.select("source", "words", F.get(cycle, (F.col("pos") % len(weights)).cast("int")).cast("bigint").alias("weight"))


def targets(sources: DataFrame, total: int | None = None, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``words``, ``weight`` with ``target``: shares of ``total`` words (default: all
    there are) by weight, at most ``repeats`` times the source's words.

    What is above goes to the others by weight, in rounds until none is above. A round is
    one sum over the sources. A total of more than all sources can give is cut to that.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    all_words, weight = sources.agg(F.sum(exact("words")), F.sum(exact("weight"))).first()
    if weight is None:
        return sources.withColumn("target", F.lit(0.0))
    most = int(all_words) * repeats
    total = int(all_words) if total is None else min(total, most)
    limit = (exact("words") * repeats).cast("decimal(38,0)")
    room, share, held = total, int(weight), 0
    while share and total < most:
        above = exact("weight") * F.lit(room).cast("decimal(20,0)") > limit * F.lit(share).cast("decimal(14,0)")
        got = sources.filter(above).agg(F.sum(limit), F.sum(exact("weight"))).first()
        capped, now_held = (int(v or 0) for v in got)
        if now_held == held:
            break
        room, share, held = total - capped, int(weight) - now_held, now_held
    if total == most:
        return sources.withColumn("target", limit.cast("double"))
    even = (exact("weight") * F.lit(room).cast("decimal(20,0)")).cast("double") / F.lit(float(share))
    return sources.withColumn("target", F.when(above, limit.cast("double")).otherwise(even))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source``, ``last_hash``, ``last_number``, ``and_last``: documents of smaller (hash,
    number) make up the source's ``budget``, and the last one if that comes nearer.

    ``sizes``: ``source``, ``size``, ``hash``, ``number``; ``budgets``: ``source`` and ``budget``,
    above 0 and at most its words. Equal hashes, of equal rows, are told apart by number.
    """
    steps = [("hash", s) for s in range(_BITS - _DIGIT, -1, -_DIGIT)] + [("number", s) for s in range(60, -1, -_DIGIT)]
    rows, rooms = sizes, budgets.select("source", F.col("budget").alias("room"))
    within = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    for column, shift in steps:
        digit = F.shiftright(column, shift).bitwiseAND((1 << _DIGIT) - 1)
        # At most 4096 rows for a source, combined in every task before they are shuffled.
        bins = rows.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        ends = bins.withColumn("upto", F.sum("words").over(within)).join(
            rooms.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
        )
        ends = ends.filter((F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("words") < F.col("room")))
        ends = stored(
            ends.select("of", F.col("digit").alias("at"), "n", (F.col("room") - F.col("upto") + F.col("words")).alias("left")),
            "mix-bounds",
        )
        inside = rows.join(ends, F.col("source").eqNullSafe(F.col("of")) & (digit == F.col("at")))
        rows = stored(inside.select("source", "size", "hash", "number"), "mix-rows")
        rooms = ends.select(F.col("of").alias("source"), F.col("left").alias("room"))
        if (ends.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    last = rows.join(rooms.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return last.select(
        "source",
        F.col("hash").alias("last_hash"),
        F.col("number").alias("last_number"),
        (2 * F.col("room") >= F.col("size")).alias("and_last"),
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] | None = None,
    weights: Sequence[int] = WEIGHTS,
    total: int | None = None,
    repeats: int = REPEATS,
) -> DataFrame:
    """``row`` (of ``keep``, by default all columns), ``size``, ``source_size``, ``target`` and
    ``copies``: how often the mix of ``total`` words takes each document, 0 to ``repeats``.

    A source's words are as near to its target as whole documents in hash order come, so off
    by half a document at most. The same documents are taken in every run: their hash is of
    key and text, and equal rows give equal results whichever of them is taken once more.
    NULL sources are one source, the last; a NULL text has no words. An empty table gives
    no rows. A source of any size is counted in parts and never sorted.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    sizes = stored(
        docs.select(
            F.monotonically_increasing_id().alias("number"),
            F.col(f"`{source}`").cast("string").alias("source"),
            word_count(F.col(f"`{text}`").cast("string")).alias("size"),
            place(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).alias("hash"),
            whole.alias("row"),
        ),
        "mix-sizes",
    )
    found = weighed(sizes.groupBy("source").agg(F.sum("size").alias("words")), weights)
    aims = stored(targets(found, total, repeats), "mix-targets")
    times = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    aims = aims.withColumn("times", F.least(times, F.lit(repeats)).cast("bigint"))
    left = F.least(F.col("target") - F.col("times") * F.col("words"), F.col("words").cast("double"))
    budgets = aims.select("source", left.alias("budget")).filter("budget > 0")
    ends = thresholds(sizes.select("source", "size", "hash", "number"), budgets)
    plan = stored(
        aims.join(ends.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        .drop("of")
        .withColumnRenamed("source", "of"),
        "mix-plan",
    )
    met = sizes.join(plan, F.col("source").eqNullSafe(F.col("of")))
    same = F.col("hash") == F.col("last_hash")
    below = (F.col("number") < F.col("last_number")) | ((F.col("number") == F.col("last_number")) & F.col("and_last"))
    extra = F.when((F.col("hash") < F.col("last_hash")) | (same & below), 1).otherwise(0)
    return met.select(
        "row", "size", F.col("words").alias("source_size"), "target", (F.col("times") + extra).cast("int").alias("copies")
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    mixed = mix(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {_BITS // 4}) AS BIGINT) AS h
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- Sources that reach their limit are those of the fewest words for their weight.
o AS (SELECT *, sum(words) OVER () - {REPEATS} * (sum(words) OVER up - words) AS room,
    sum(weight) OVER () - sum(weight) OVER up + weight AS share
    FROM s WINDOW up AS (ORDER BY words * 1.0 / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT room, share FROM o WHERE {REPEATS} * words * share >= weight * room ORDER BY share DESC LIMIT 1),
t AS (SELECT source, words, CASE WHEN weight * l.room > {REPEATS} * words * l.share THEN CAST({REPEATS} * words AS DOUBLE)
    ELSE CAST(weight * l.room AS DOUBLE) / CAST(l.share AS DOUBLE) END AS target FROM s, l),
b AS (SELECT *, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS times FROM t),
c AS (SELECT d.*, words, target, times, target - times * words AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, words AS source_size, target, CAST(size * (times + CASE WHEN upto < budget THEN 1
    WHEN upto - size < budget AND 2 * (budget - upto + size) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
