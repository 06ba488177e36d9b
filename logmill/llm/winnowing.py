"""Benchmark decontamination by winnowing.

Texts are word sequences. Of every ``WINDOW - GRAM + 1`` successive k-grams the one with
the smallest hash is kept as a fingerprint, the rightmost among equals, so two texts that
share ``WINDOW`` words share a fingerprint at the same place of that span. Training
fingerprints meet test fingerprints in a join on the hash. Each carries the words around
it, as far as a window that holds it can reach; hits are extended over them word by word,
and a run of at least ``WINDOW`` words is a shared span. Test items shorter than a window
are one window of their own length: k = that length, nothing is thinned out.

Built-in expressions only. Words are compared by 64-bit hash.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import UPPER, lower_ascii, read_table

WINDOW, GRAM = 13, 6
# Test fingerprints up to this many (some 50 MB) are broadcast; more meet in a shuffle.
BROADCAST_FINGERPRINTS = 200_000
# A document is contaminated if this many times its hit words reach all its words.
HIT_FACTOR = 20
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LAST = 0x7FFFFFFF
_FINGERPRINT = "struct<gram:bigint,at:int,size:int,left:int,around:array<bigint>>"


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words in order; NULL has none."""
    words = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _positions(last: Column) -> Column:
    """0 to ``last``; empty if ``last`` is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, size: int) -> Column:
    return F.transform(
        _positions(F.size(words) - size),
        lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)]),
    )


def _thinned(grams: Column, sliding: int) -> Column:
    """Places of the smallest gram of every ``sliding`` successive ones."""
    # Upper half of the hash, then the place counted backwards: the minimum is the
    # rightmost of equals, wherever the span stands in its text.
    ranked = lambda grams: F.transform(
        grams, lambda g, i: F.shiftleft(F.shiftright(g, 32), 32).bitwiseOR((_LAST - i).cast("bigint"))
    )
    smallest = lambda ranked: F.transform(
        _positions(F.size(ranked) - sliding),
        lambda j: F.least(*[F.get(ranked, j + k) for k in range(sliding)]),
    )
    places = F.array_distinct(_let(ranked(grams), smallest))
    return F.transform(places, lambda p: (_LAST - p.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fingerprints(words: Column) -> Column:
    """Fingerprints of all windows of a text."""
    reach = WINDOW - GRAM

    def around(grams: Column) -> Column:
        def one(at: Column) -> Column:
            left = F.least(at, F.lit(reach))
            return F.struct(
                F.get(grams, at).alias("gram"),
                at.alias("at"),
                F.lit(WINDOW).alias("size"),
                left.alias("left"),
                F.slice(words, at - left + 1, left + GRAM + reach).alias("around"),
            )

        return F.transform(_thinned(grams, reach + 1), one)

    return _let(_grams(words, GRAM), around).cast(f"array<{_FINGERPRINT}>")


def _short_windows(words: Column, size: int) -> Column:
    """Every window of ``size`` words, without surroundings."""
    return F.transform(
        _grams(words, size),
        lambda gram, at: F.struct(
            gram.alias("gram"),
            at.alias("at"),
            F.lit(size).alias("size"),
            F.lit(None).cast("int").alias("left"),
            F.lit(None).cast("array<bigint>").alias("around"),
        ),
    ).cast(f"array<{_FINGERPRINT}>")


def _all_fingerprints(words: Column, sizes: list[int]) -> Column:
    """Fingerprints of whole windows, and all windows of the given smaller sizes."""
    return F.concat(_fingerprints(words), *[_short_windows(words, size) for size in sizes])


def test_fingerprints(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """One row per fingerprint of a test item (``item`` as text, ``test``); window sizes below WINDOW."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), word_hashes(F.col(text)).alias("words"))
    size = F.least(F.size("words"), F.lit(WINDOW))
    sizes = sorted(r[0] for r in rows.select(size).distinct().collect())
    short = [n for n in sizes if 0 < n < WINDOW]
    words = F.col("words")
    own = F.when(F.size(words) >= WINDOW, _fingerprints(words))
    for n in short:
        own = own.when(F.size(words) == n, _short_windows(words, n))
    return rows.select("item", F.explode(own).alias("test")), short


def _run_length(doc: Column, doc_from: Column, test: Column, test_from: Column, step: int) -> Column:
    """How many words equal each other from there on, at most as far as a window reaches."""
    equal = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOW - GRAM)),
        lambda i: F.when(
            i < WINDOW - GRAM,
            F.coalesce(
                (doc_from + i * step >= 0)
                & (test_from + i * step >= 0)
                & (F.get(doc, doc_from + i * step) == F.get(test, test_from + i * step)),
                F.lit(False),
            ),
        ).otherwise(F.lit(False)),
    )
    return (F.array_position(equal, False) - 1).cast("int")


def _span() -> Column:
    """(first, last) hit word of a joined pair; NULL if the run is shorter than a window."""
    doc, test = F.col("doc.around"), F.col("test.around")
    at_doc, at_test = F.col("doc.left"), F.col("test.left")
    before = _run_length(doc, at_doc - 1, test, at_test - 1, -1)
    after = _run_length(doc, at_doc + GRAM, test, at_test + GRAM, 1)
    same = F.slice(doc, at_doc + 1, GRAM) == F.slice(test, at_test + 1, GRAM)
    at, size = F.col("doc.at"), F.col("doc.size")
    span = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    whole = F.when(F.col("test.size") == size, span(at, at + size - 1))
    run = F.when(same & (before + GRAM + after >= WINDOW), span(at - before, at + GRAM - 1 + after))
    return F.when(F.col("test.around").isNull(), whole).otherwise(run)


def _covered(spans: Column) -> Column:
    """Words in the union of spans sorted by their first word."""
    return F.aggregate(
        spans,
        F.struct(F.lit(-1).alias("reach"), F.lit(0).cast("bigint").alias("total")),
        lambda so_far, s: F.struct(
            F.greatest(so_far["reach"], s["last"]).alias("reach"),
            (
                so_far["total"]
                + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, so_far["reach"]))
            ).alias("total"),
        ),
        lambda so_far: so_far["total"],
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document row: kept columns and what it shares with test items.

    ``n_words``; ``n_hit``: words inside any occurrence of a window; ``items``: ids (as
    text, sorted) of items with occurring windows; ``spans``: shared spans as (first,
    last) word; ``contaminated``. NULL and empty texts have no words, items without words
    no window. Items without an id hit words but are not listed. Repeated rows stay. Kept
    columns with one of these names give way to the results.

    One pass over the texts and one shuffle: the list of a document's spans and items is
    bounded by its own words and by the benchmark.
    """
    results = ("n_words", "n_hit", "items", "spans", "contaminated")
    kept = [c for c in keep if c not in results]
    tests, short = test_fingerprints(items, item_id, item_text)
    if tests.count() <= BROADCAST_FINGERPRINTS:
        tests = F.broadcast(tests)

    words = F.col("words")
    # Every document sends one row of its own, which matches nothing.
    own = F.array(
        F.struct(
            F.xxhash64("row_number").alias("gram"),
            F.lit(-1).alias("at"),
            F.lit(0).alias("size"),
            F.lit(None).cast("int").alias("left"),
            F.lit(None).cast("array<bigint>").alias("around"),
        )
    ).cast(f"array<{_FINGERPRINT}>")
    prints = F.concat(own, _all_fingerprints(words, short))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_number"),
        F.struct(*kept).alias("kept"),
        word_hashes(F.col(text)).alias("words"),
    ).select(
        "row_number", "kept", F.size("words").cast("bigint").alias("n_words"), F.explode(prints).alias("doc")
    )
    is_own = F.col("doc.at") < 0
    found = (
        rows.join(tests, F.col("doc.gram") == F.col("test.gram"), "left")
        .withColumn("span", F.when(~is_own, _span()))
        .filter(is_own | F.col("span").isNotNull())
        .groupBy("row_number")
        .agg(
            F.first(F.when(is_own, F.col("kept")), ignorenulls=True).alias("kept"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.array_sort(F.collect_set(F.when(~is_own, F.col("item")))).alias("items"),
        )
    )
    n_hit = _covered(F.col("spans"))
    return found.select("kept.*", "n_words", n_hit.alias("n_hit"), "items", "spans").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (HIT_FACTOR * F.col("n_hit") >= F.col("n_words"))
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words shared with ``benchmark``."""
    docs, items = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return contamination(docs, items, ["doc_id"]).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def _sql_words(table: str, key: str) -> str:
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    return rf"SELECT {key}, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


OP4_SQL = f"""
WITH doc AS ({_sql_words("documents", "doc_id")}),
item AS ({_sql_words("benchmark", "item_id")}),
cut AS (SELECT item_id, w, least(len(w), {WINDOW}) AS size FROM item WHERE len(w) > 0),
test AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM cut)),
place AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc, (SELECT DISTINCT size FROM test))),
hit AS (SELECT DISTINCT doc_id, item_id, i, size FROM place JOIN test USING (size, win)),
word AS (SELECT doc_id, count(DISTINCT spot) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM hit) GROUP BY doc_id),
which AS (SELECT doc_id, count(*) AS n_items, string_agg(key, ',' ORDER BY key) AS keys
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS key FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(keys, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND {HIT_FACTOR} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN which USING (doc_id)
"""
