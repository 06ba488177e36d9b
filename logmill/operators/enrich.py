"""Parsed rows to the stored layout: request parts, minute, date, log instant."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.functions.clock import minute_label, parse_log_time, record_clock
from logmill.functions.request import REQUEST_PARTS, request_parts
from logmill.schema import ENRICHED_FIELDS


def enrich(
    parsed: DataFrame, record_time: str = "process_timestamp", zone: str = "UTC"
) -> DataFrame:
    """The stored columns, after any extra columns of ``parsed``.

    ``record_time`` is when the record reached the topic. Its minute and date are
    taken in ``zone``, for every reader alike. ``request`` is replaced by its parts.
    Columns whose line field was not parsed are left out.
    """
    clock = record_clock(parsed, record_time, zone)
    derived = {
        "process_timestamp": minute_label(clock).alias("process_timestamp"),
        "process_date": clock.cast("date").alias("process_date"),
    }
    if "log_timestamp" in parsed.columns:
        derived["log_timestamp"] = parse_log_time(F.col("log_timestamp")).alias("log_timestamp")
    if "request" in parsed.columns:
        derived.update(zip(REQUEST_PARTS, request_parts(F.col("request"))))
    stored = [name for name in ENRICHED_FIELDS if name in derived or name in parsed.columns]
    dropped = {*stored, "request", record_time}
    extra = [F.col(f"`{c}`") for c in parsed.columns if c not in dropped]
    return parsed.select(*extra, *[derived.get(name, F.col(name)) for name in stored])
