"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier on hashed
character n-grams tells the languages whose bit is 1 from the others. A text is decoded
to the codeword of the smallest loss, each bit's loss weighted by how well that bit was
told apart in training. Codewords are far from each other, so a few wrong bits do no
harm. The score is the share of the nearest codeword in the softmax of the losses; a
text whose two nearest codewords are about equally near is flagged as ambiguous.

The classifiers are fitted on the driver, on at most ``SAMPLE_ROWS`` labelled rows drawn
evenly over the languages; prediction reads whole texts, in tasks.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import crc_fold, map_batches, read_table

FOLDS, HELD_OUT = 4, 2
# Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 1000
BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
# Languages up to this many get every split into two as a bit; more get random codewords.
ALL_SPLITS = 6
BITS_PER_DOUBLING = 12
RIDGE = 1e-3
# Share below which the nearest codeword does not stand out.
AMBIGUOUS = 0.6
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
# Rows that are scored at once.
_ROWS = 256
# Characters hashed at once, whatever the length of a text.
_SLICE = 1 << 20


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of a lower-cased text, letters and blanks alone."""
    words = f" {_OTHER.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(words.encode("utf-32-le"), "<u4").astype(np.uint64)
    counts = np.zeros(BUCKETS, np.int64)
    reach = max(ORDERS) - 1
    for start in range(0, len(codes), _SLICE):
        part = codes[start : start + _SLICE + reach]
        for order in ORDERS:
            # N-grams that begin in this slice.
            size = min(len(part) - order + 1, _SLICE)
            if size <= 0:
                continue
            mixed = np.full(size, order, np.uint64)
            for k in range(order):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + part[k : k + size]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            counts += np.bincount((mixed >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    return counts


def features(text: str) -> np.ndarray:
    """Square roots of the n-grams' shares: a vector of length 1 for any text."""
    counts = gram_counts(text)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 per language; columns are the bits."""
    if languages <= 2:
        return np.array([[1.0], [-1.0]][:languages] or np.zeros((0, 1)))
    if languages <= ALL_SPLITS:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where(splits >> np.arange(languages)[:, None] & 1, -1.0, 1.0)
    bits = BITS_PER_DOUBLING * int(np.ceil(np.log2(languages)))
    draws = [np.random.default_rng(seed).choice([-1.0, 1.0], (languages, bits)) for seed in range(20)]

    def distance(code: np.ndarray) -> float:
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        return agree.max()

    return min(draws, key=distance)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    bit_weights: np.ndarray
    sharpness: float

    def losses(self, rows: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword for every row."""
        margins = np.clip(rows @ self.weights + self.offsets, -1.5, 1.5)
        miss = np.maximum(0.0, 1.0 - margins[:, None, :] * self.code[None])
        return miss @ self.bit_weights

    def shares(self, rows: np.ndarray) -> np.ndarray:
        near = -self.sharpness * self.losses(rows)
        near = np.exp(near - near.max(axis=1, keepdims=True))
        return near / near.sum(axis=1, keepdims=True)


def fit(rows: np.ndarray, labels: list[str]) -> LanguageModel:
    """One ridge classifier per bit; without rows, a model that knows no language.

    ``rows`` are overwritten.
    """
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if not languages:
        return LanguageModel([], code, np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1), 1.0)
    place = np.array([languages.index(label) for label in labels])
    # Every language weighs the same, whatever its number of rows.
    weight = (1.0 / np.bincount(place, minlength=len(languages)))[place] / len(languages)
    target = code[place]
    centre, goal = weight @ rows, weight @ target
    # In place: the driver holds one copy.
    scaled, root = rows, np.sqrt(weight)[:, None]
    scaled -= centre
    scaled *= root
    # Rows are fewer than buckets, so solve among the rows.
    gram = scaled @ scaled.T + RIDGE * np.eye(len(rows)) / len(rows)
    weights = scaled.T @ np.linalg.solve(gram, (target - goal) * root)
    offsets = goal - centre @ weights
    error = weight @ (np.sign(scaled @ weights / root + goal) != target)
    bits = np.log((1.0 - error + 1e-2) / (error + 1e-2))
    bits = np.maximum(bits, 1e-3)
    return LanguageModel(languages, code, weights, offsets, bits / bits.sum(), 6.0)


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on at most ``SAMPLE_ROWS`` rows with a language and a letter.

    Rows are drawn by a hash of the text alone, at one rate per language that evens the
    languages out, so the same texts give the same model whatever their ids. Copies of a
    text count once. A table without such rows gives a model that answers ``und``.
    """
    usable = rows.select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("draw"),
    ).filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("draw").alias("count")).orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()
    quota = max(1, SAMPLE_ROWS // max(1, len(counts)))
    spark = rows.sparkSession
    # Somewhat more than the quota is drawn, then cut to it.
    rates = [(r["lang"], min(1.0, 1.5 * quota / r["count"])) for r in counts]
    rated = usable.join(F.broadcast(spark.createDataFrame(rates, "known string, rate double")), F.col("lang") == F.col("known"))
    drawn = rated.filter((F.shiftrightunsigned("draw", 11) / float(1 << 53)) < F.col("rate"))
    drawn = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    # Which rows, by their draws alone; then the n-grams of just those.
    draws = drawn.select("lang", "draw").orderBy("draw", "lang").limit(2 * SAMPLE_ROWS).collect()
    chosen: dict[str, list[int]] = {}
    for row in draws:
        mine = chosen.setdefault(row["lang"], [])
        if len(mine) < quota and sum(map(len, chosen.values())) < SAMPLE_ROWS:
            mine.append(row["draw"])
    picked = spark.createDataFrame([(k, d) for k, mine in chosen.items() for d in mine], "chosen string, at bigint")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(text).tobytes() for text in batch.column("text").to_pylist()]
        columns = [batch.column("lang"), batch.column("draw"), pa.array(found, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "draw", "grams"])

    rows = drawn.join(F.broadcast(picked), (F.col("lang") == F.col("chosen")) & (F.col("draw") == F.col("at")))
    told = map_batches(rows.select("lang", "draw", "text"), run, "lang string, draw bigint, grams binary").toArrow()
    told = told.sort_by([("draw", "ascending"), ("lang", "ascending")])
    grams = np.empty((told.num_rows, BUCKETS), np.float64)
    for at, row in enumerate(told.column("grams")):
        grams[at] = np.frombuffer(row.as_buffer(), np.float32)
    return fit(grams, told.column("lang").to_pylist())


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns, ``lang_pred``, ``score``, ``ambiguous`` and ``runner_up`` of whole texts.

    NULL texts and texts without a letter are ``und`` with score 0, not ambiguous. Equal
    losses go to the language that comes first in the alphabet. Only the text is read for
    a prediction. Repeated rows stay; kept columns named like a result give way to it.
    """
    results = ("lang_pred", "score", "ambiguous", "runner_up")
    kept = [c for c in keep if c not in results]
    whole = F.col(text).cast("string")
    rows = docs.select(F.struct(*kept).alias("row"), whole.alias("text"), has_letter(whole).alias("told"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        found = [(UNKNOWN, 0.0, False, None)] * batch.num_rows
        texts = batch.column("text").to_pylist()
        told = [i for i, t in enumerate(batch.column("told").to_pylist()) if t] if model.languages else []
        for start in range(0, len(told), _ROWS):
            part = told[start : start + _ROWS]
            shares = model.shares(np.stack([features(texts[i]) for i in part]))
            order = np.argsort(-shares, axis=1, kind="stable")
            for i, share, (best, *others) in zip(part, shares, order, strict=True):
                second = model.languages[others[0]] if others else None
                score = float(share[best])
                found[i] = (model.languages[best], score, score < AMBIGUOUS, second)
        columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_(), pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *results])

    schema = (
        f"row {rows.schema['row'].dataType.simpleString()}, "
        "lang_pred string, score double, ambiguous boolean, runner_up string"
    )
    return map_batches(rows, run, schema).select("row.*", *results)


def held_out(key: Column) -> Column:
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(crc_fold(key, FOLDS) == HELD_OUT, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous", "runner_up"
    )
