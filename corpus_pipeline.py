"""From raw documents to token ids, in stages that are each written and read again.

Every stage takes what its predecessor kept; all but the last return the columns of
``documents``. ``STAGES`` lists them, ``run`` applies them to ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import numbered, read_table, stored
from logmill.llm.language_id import UNKNOWN, held_out, predict, train
from logmill.llm.sentencepiece_bpe import MODEL, encode_decode
from logmill.llm.simhash import near_duplicates
from logmill.llm.surrogates import replace_entities
from logmill.llm.winnowing import contamination


def _text_of(rows: DataFrame) -> DataFrame:
    return rows.select("number", F.col("row.text").alias("text"))


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose number is not among ``rejected``, as they were."""
    gone = rejected.select(F.col("number").alias("gone"))
    return rows.join(gone, F.col("number") == F.col("gone"), "left_anti").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told clearly.

    Those without a letter go, and those between languages: no codeword stands out. The
    classifiers learn from the documents' own labels. If none has one, all stay that have
    a letter.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    told = predict(docs.select(whole.alias("row"), "text"), model, ["row"])
    if not model.languages:
        return told.filter(F.col("row.text").rlike(r"\p{L}")).select("row.*")
    return told.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Groups are those of the operator's contract: 3-word shingles, chains of fingerprints
    within 3 bits. NULL ids come last; of rows with one id, one stays.
    """
    rows = numbered(docs)
    groups = near_duplicates(_text_of(rows), "number")
    ids = rows.select("number", F.col("row.doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "number")
    first = (
        groups.select(F.col("doc_id").alias("member"), "component_id")
        .join(ids, F.col("member") == F.col("number"))
        .withColumn("order", order)
    )
    kept = first.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.number").alias("kept"))
    return rows.join(kept, F.col("number") == F.col("kept"), "left_semi").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a 20th lies in passages of ``benchmark``."""
    rows = numbered(docs)
    judged = contamination(_text_of(rows), read_table(spark, sf_dir, "benchmark"), ["number"])
    return _without(rows, judged.filter("contaminated"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data, and ``n_chars`` of the new text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    new = replace_entities(rows)
    held = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    column = lambda c: held[c] if c in held else F.col("row")[c]
    return new.select(*[column(c).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the token ids, and whether they decode to the text."""
    found = encode_decode(docs, public_tokenizers.path(MODEL), ["doc_id", "lang", "source", "text"])
    text = F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return found.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.col("decoded") == text).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("replace_pii", replace_pii),
    ("tokenize", tokenize),
]

# Classifiers, fingerprints and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
