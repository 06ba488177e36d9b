"""Per-minute figures of one day, over stored rows or over a minute rollup.

``facts`` is either the table of enriched rows or the current figures per minute and
code that a stream keeps (:func:`logmill.streaming.rollup.read_rollup`), which answer
the same questions from a few thousand rows a day.

``day`` is a date, a datetime, ``yyyy-mm-dd`` or ``yyyymmdd``; the default is today in ``zone``. The day is a
filter on the partition column, so only that day's files are read. Each figure is
limited to the latest ``k`` groups.
"""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions.clock import as_day, today


def _day(day: str | date | None, zone: str) -> Column:
    return F.lit(today(zone) if day is None else as_day(day))


def day_rows(facts: DataFrame, day: str | date | None = None, zone: str = "UTC") -> DataFrame:
    return facts.where(F.col("process_date") == _day(day, zone))


def _requests(rows: DataFrame) -> Column:
    return F.sum("total_count") if "total_count" in rows.columns else F.count("*")


def _bytes(rows: DataFrame) -> Column:
    return F.sum("output_bytes" if "output_bytes" in rows.columns else "response_bytes")


def response_codes_by_minute(
    facts: DataFrame, day: str | date | None = None, zone: str = "UTC", k: int = 10
) -> DataFrame:
    """Requests per minute and code. ``k`` counts (minute, code) pairs."""
    return (
        day_rows(facts, day, zone)
        .groupBy("process_timestamp", "response_code")
        .agg(_requests(facts).alias("total_count"))
        .orderBy(F.desc("process_timestamp"), F.desc("response_code"))
        .limit(k)
    )


def output_bytes_by_minute(
    facts: DataFrame, day: str | date | None = None, zone: str = "UTC", k: int = 10
) -> DataFrame:
    return (
        day_rows(facts, day, zone)
        .groupBy("process_timestamp")
        .agg(_bytes(facts).alias("output_bytes"))
        .orderBy(F.desc("process_timestamp"))
        .limit(k)
    )


def total_requests_by_minute(
    facts: DataFrame, day: str | date | None = None, zone: str = "UTC", k: int = 10
) -> DataFrame:
    return (
        day_rows(facts, day, zone)
        .groupBy("process_timestamp")
        .agg(_requests(facts).alias("total_requests"))
        .orderBy(F.desc("process_timestamp"))
        .limit(k)
    )


def response_code_distribution(
    facts: DataFrame, day: str | date | None = None, zone: str = "UTC", k: int = 10
) -> DataFrame:
    """Per code, the total of the latest ``k`` (minute, code) pairs."""
    return (
        response_codes_by_minute(facts, day, zone, k)
        .groupBy("response_code")
        .agg(F.sum("total_count").alias("total_count"))
    )


def day_has_data(
    facts: DataFrame, day: str | date | None = None, zone: str = "UTC"
) -> DataFrame:
    """One row (day, has_data). Each task stops at its first row of the day."""
    found = day_rows(facts, day, zone).limit(1)
    return found.agg((F.count("*") > 0).alias("has_data")).select(
        _day(day, zone).alias("day"), "has_data"
    )


def rows_as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("row_json"))
