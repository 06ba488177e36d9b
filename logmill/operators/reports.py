"""Whole-log statistics over parsed rows.

Each is one aggregation: rows are combined within each task first, so a value that
holds a third of the log still sends one row per task through the shuffle.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of the bitmap that ``totals`` makes, 4 kB; other codes are counted only.
_LEAST_CODE, _MOST_CODE = 1, 32768


def content_size_stats(parsed: DataFrame) -> DataFrame:
    """Mean (truncated), smallest and largest body; NULLs for an empty log."""
    size = F.col("response_bytes")
    return parsed.agg(
        F.expr("sum(response_bytes) div nullif(count(response_bytes), 0)").alias("avg_bytes"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
    )


def code_summary(parsed: DataFrame) -> DataFrame:
    """Per code, what the whole-log figures are made of: a row per code, from one pass."""
    size = F.col("response_bytes")
    return parsed.groupBy("response_code").agg(
        F.count("*").alias("total_count"),
        F.sum(size).alias("sum_bytes"),
        F.count(size).alias("sized"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
    )


def content_size_of(summary: DataFrame) -> DataFrame:
    """``content_size_stats`` from ``code_summary``."""
    return summary.agg(
        F.expr("sum(sum_bytes) div nullif(sum(sized), 0)").alias("avg_bytes"),
        F.min("min_bytes").alias("min_bytes"),
        F.max("max_bytes").alias("max_bytes"),
    )


def totals(counts: Column) -> list[Column]:
    """What ``content_size_from`` and ``code_totals_from`` need of the rows that ``counts`` is
    true of: aggregates of bounded size that cannot overflow, to be observed while the rows
    are written."""
    size, code = F.when(counts, F.col("response_bytes")), F.when(counts, F.col("response_code"))
    within = code.between(_LEAST_CODE, _MOST_CODE)
    return [
        F.count_if(counts).alias("total_requests"),
        F.sum(size.cast("decimal(20,0)")).alias("sum_bytes"),
        F.count(size).alias("sized"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
        F.bitmap_construct_agg(F.bitmap_bit_position(F.when(within, code).cast("bigint"))).alias("codes"),
        F.count_if(~within).alias("odd_codes"),
    ]


def content_size_from(spark: SparkSession, found: dict) -> DataFrame:
    """``content_size_stats`` from the values of ``totals``."""
    mean = int(found["sum_bytes"]) // found["sized"] if found["sized"] else None
    row = (mean, found["min_bytes"], found["max_bytes"])
    return spark.createDataFrame([row], "avg_bytes bigint, min_bytes bigint, max_bytes bigint")


def code_totals_from(spark: SparkSession, found: dict) -> DataFrame | None:
    """``response_code_totals`` from the values of ``totals``; None if odd codes occur, whose
    number is not bounded and needs a pass of its own."""
    if found["odd_codes"]:
        return None
    codes = int.from_bytes(bytes(found["codes"])).bit_count()
    return spark.createDataFrame([(codes, found["total_requests"])], "distinct_codes bigint, total_requests bigint")


def response_code_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("response_code").agg(F.count("*").alias("total_count"))


def top_response_codes(parsed: DataFrame, k: int = 10) -> DataFrame:
    return top_codes_of(response_code_counts(parsed), k)


def top_codes_of(counts: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent codes, from counts or a summary per code."""
    rows = counts.select("response_code", "total_count")
    return rows.orderBy(F.desc("total_count"), F.asc("response_code")).limit(k)


def response_code_totals(parsed: DataFrame) -> DataFrame:
    """Number of different codes and of requests, from the per-code counts."""
    return code_totals_of(response_code_counts(parsed))


def code_totals_of(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count("response_code").alias("distinct_codes"),
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("total_requests"),
    )


def _requests_per(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.groupBy(column).agg(F.count("*").alias("total_requests"))


def top_user_agents(parsed: DataFrame, k: int = 5) -> DataFrame:
    return top_agents_of(_requests_per(parsed, "user_agent"), k)


def top_agents_of(counts: DataFrame, k: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("total_requests"), F.asc("user_agent")).limit(k)


def requests_per_user_agent(parsed: DataFrame) -> DataFrame:
    return _requests_per(parsed, "user_agent")


def requests_per_timestamp(parsed: DataFrame) -> DataFrame:
    """Requests per log time as written (one instant in two offsets is two rows).

    Ascending. The time itself is a second sort key, which also lets the range
    partitioning split the many times that share one count.
    """
    return _requests_per(parsed, "log_timestamp").orderBy("total_requests", "log_timestamp")


def requests_per_ip(parsed: DataFrame) -> DataFrame:
    return _requests_per(parsed, "ip_address").orderBy("total_requests", "ip_address")


def preview(parsed: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """The first ``k`` rows by ``key``."""
    return parsed.select(key, *columns).orderBy(key).limit(k)
