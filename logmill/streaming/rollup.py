"""Requests and bytes per minute and response code, kept up to date by a stream.

Counts and sums add up, so a stream needs no state for them: each micro-batch stores the
counts of its own rows, and reading adds the batches. However late a row is, it counts.
"""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logmill.functions.clock import minute_label, wall_clock
from logmill.operators.parse import DROPMALFORMED, FAILFAST
from logmill.schema import LOAD_FIELDS, ddl
from logmill.sources.tables import gather, read_by_date, write_load
from logmill.streaming.accounts import Accounts
from logmill.streaming.pipelines import (
    STORE,
    Writer,
    fan_out,
    parse_records,
    quarantine_writer,
)

ROLLUP_FIELDS = {
    "minute": "timestamp_ntz",
    "response_code": "int",
    "total_count": "bigint",
    "output_bytes": "bigint",
    "process_date": "date",
}
_PARSED = ["response_code", "response_bytes"]


def rollup_writer(path: str) -> Writer:
    """Counts of a batch's rows per minute and code; a repeated batch replaces its own."""

    def write(rows: DataFrame, load_id: str, batch_id: int) -> None:
        minute = F.concat("process_timestamp", F.lit(":00")).cast("timestamp_ntz")
        counted = rows.groupBy("process_date", minute.alias("minute"), "response_code").agg(
            F.count("*").alias("total_count"), F.sum("response_bytes").alias("output_bytes")
        )
        write_load(counted.select(*ROLLUP_FIELDS), path, load_id, batch_id, ["process_date"], cluster=True)

    return write


def update_rollup(
    recs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, zone: str = "UTC",
    quarantine: str | None = None,
) -> StreamingQuery:
    """Add every batch's counts to the table; read it with :func:`read_rollup`.

    Bad records are kept, with their reason, in the table ``quarantine``, by default next
    to the rollup.
    """
    bad = quarantine_writer(quarantine or f"{path.rstrip('/')}_quarantine")
    return fan_out(recs, [rollup_writer(path)], [bad], checkpoint, trigger, zone, _PARSED)


def minute_rollup(
    recs: DataFrame, delay: str, zone: str = "UTC", mode: str = DROPMALFORMED
) -> DataFrame:
    """Tumbling one-minute windows on record time; ``minute`` is wall clock in ``zone``.

    A stream closes a window once records are ``delay`` newer, and leaves out what comes
    later; see :func:`dropped_rows`. State is one row per open (minute, code).
    """
    parsed = parse_records(recs, _PARSED, mode)
    counted = (
        parsed.withWatermark("process_timestamp", delay)
        .groupBy(F.window("process_timestamp", "1 minute"), "response_code")
        .agg(
            F.count("*").alias("total_count"),
            F.sum("response_bytes").alias("output_bytes"),
        )
    )
    minute = wall_clock(F.col("window.start"), zone)
    return counted.select(
        minute.alias("minute"),
        "response_code",
        "total_count",
        "output_bytes",
        minute.cast("date").alias("process_date"),
    )


def append_rollup(
    recs: DataFrame, path: str, checkpoint: str, delay: str,
    trigger: dict | None = None, zone: str = "UTC", mode: str = FAILFAST,
) -> StreamingQuery:
    """Write each window once, after the watermark has passed it.

    For sinks that cannot add up: rows later than ``delay`` are left out and counted by
    :func:`dropped_rows`, and a bad record stops the stream. ``update_rollup`` loses neither.
    """
    return (
        gather(minute_rollup(recs, delay, zone, mode), ["process_date"])
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("process_date")
        .trigger(**(trigger or STORE))
        .start()
    )


def dropped_rows(query: StreamingQuery, accounts: Accounts | None = None) -> int:
    """Rows that came later than the watermark: of all batches that ``accounts`` were kept of,
    else of the query's last hundred."""
    if accounts is not None:
        accounts.settle()
        return accounts.of(query.id).left_out
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )


def read_rollup(
    spark: SparkSession, path: str, day: str | date | None = None
) -> DataFrame:
    """Current figures of an updated rollup: the sums over all batches."""
    counted = read_by_date(spark, path, ddl(ROLLUP_FIELDS, LOAD_FIELDS), day)
    current = counted.groupBy("process_date", "minute", "response_code").agg(
        F.sum("total_count").alias("total_count"),
        F.sum("output_bytes").alias("output_bytes"),
    )
    return current.withColumn("process_timestamp", minute_label(F.col("minute")))
