"""Streams of topic records into tables. The same functions as the batch jobs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from logmill.operators.enrich import enrich
from logmill.operators.parse import (
    DROPMALFORMED,
    PERMISSIVE,
    good_rows,
    malformed_rows,
    parse_lines,
)
from logmill.schema import ENRICHED_FIELDS, ddl
from logmill.sources.lines import decode_records
from logmill.sources.tables import gather
from logmill.streaming.accounts import counted
from logmill.streaming.sinks import (
    Writer,
    connector_writer,
    console_writer,
    fact_writer,
    quarantine_writer,
    side_by_side,
)

__all__ = [
    "DRAIN", "REFRESH", "STORE", "Writer", "append_to_parquet", "await_streams", "connector_writer", "console_writer",
    "fact_writer", "fan_out", "judge_records", "load_of", "parse_records", "quarantine_writer", "read_appended", "to_console",
]

# Fixed value: how often a live view is refreshed. Every trigger leaves files in a table,
# so tables are written less often.
REFRESH = {"processingTime": "10 seconds"}
STORE = {"processingTime": "1 minute"}
DRAIN = {"availableNow": True}

_APPENDED = ["is_malformed", "process_date"]


def judge_records(
    recs: DataFrame, fields: list[str] | None = None, mode: str = PERMISSIVE
) -> DataFrame:
    """Decode and parse records. ``PERMISSIVE`` keeps every record, with ``raw`` and ``reason``."""
    return parse_lines(
        decode_records(recs), fields=fields, mode=mode,
        payload_reason="payload_reason", payload="payload",
    )


def parse_records(
    recs: DataFrame, fields: list[str] | None = None, mode: str = DROPMALFORMED
) -> DataFrame:
    """Decode and parse records; only those that parse are kept, or the first bad one raises."""
    if mode == PERMISSIVE:
        raise ValueError("bad records are kept by judge_records")
    decoded = decode_records(recs).drop("payload", "payload_reason")
    return parse_lines(decoded, fields=fields, mode=mode)


def load_of(batch: DataFrame) -> str:
    """Id of the streaming query a micro-batch belongs to; it lives in the checkpoint."""
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query_id:
        raise RuntimeError("not called for a micro-batch of a streaming query")
    return query_id


def append_to_parquet(
    recs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, zone: str = "UTC",
    cluster: bool = True, mode: str = PERMISSIVE,
) -> StreamingQuery:
    """Records to a file sink, exactly once, by ``is_malformed`` and date.

    Good and bad records go through one sink and one checkpoint, so none is lost and
    nothing is renamed; read them with :func:`read_appended`. ``DROPMALFORMED`` leaves
    bad records out, ``FAILFAST`` stops at the first. ``cluster`` gathers each batch's
    rows by date; Spark plans streams without state adaptively from 4.1 on, so pass
    False on older versions.
    """
    if mode == PERMISSIVE:
        judged = counted(judge_records(recs))
    else:
        judged = parse_records(recs, mode=mode)
        judged = judged.selectExpr("*", "CAST(NULL AS STRING) AS raw", "CAST(NULL AS STRING) AS reason")
    rows = enrich(judged, zone=zone).withColumn("is_malformed", F.col("reason").isNotNull())
    if cluster:
        rows = gather(rows, _APPENDED)
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*_APPENDED)
        .trigger(**(trigger or STORE))
        .start()
    )


def read_appended(
    spark: SparkSession, path: str, malformed: bool = False, extra: dict[str, str] | None = None
) -> DataFrame:
    """What :func:`append_to_parquet` has stored: good rows, or bad records with ``raw`` and ``reason``."""
    why = {"raw": "string", "reason": "string"}
    stored = spark.read.schema(ddl(extra or {}, why, ENRICHED_FIELDS, {"is_malformed": "boolean"})).parquet(path)
    columns = [*(extra or {}), *(["process_timestamp", "raw", "reason"] if malformed else ENRICHED_FIELDS)]
    return stored.where(F.col("is_malformed") == F.lit(malformed)).select(*columns)


def fan_out(
    recs: DataFrame,
    facts: list[Writer],
    quarantine: list[Writer],
    checkpoint: str,
    trigger: dict | None = None,
    zone: str = "UTC",
    fields: list[str] | None = None,
) -> StreamingQuery:
    """One read and one parse per micro-batch, several tables.

    ``fields`` limits what is parsed to some line fields. The writers of a batch work side by
    side; if one fails, the others are cancelled and the batch runs again. Writers get the
    query's id and the batch number, so a table can replace instead of repeat.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        load_id = load_of(batch)
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = enrich(good_rows(batch), zone=zone), malformed_rows(batch)
            jobs = [(writer, good) for writer in facts] + [(writer, bad) for writer in quarantine]
            side_by_side(
                batch.sparkSession,
                [lambda w=writer, rows=rows: w(rows, load_id, batch_id) for writer, rows in jobs],
            )
        finally:
            batch.unpersist()

    return (
        counted(judge_records(recs, fields))
        .writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or STORE))
        .start()
    )


def to_console(rows: DataFrame, trigger: dict | None = None) -> StreamingQuery:
    """Show each micro-batch's first rows on the driver, for debugging."""
    return (
        rows.writeStream.format("console")
        .outputMode("append")
        .trigger(**(trigger or REFRESH))
        .start()
    )


def await_streams(*queries: StreamingQuery) -> None:
    """Wait for all queries. If one fails, stop the others and raise its error."""
    running = list(queries)
    try:
        while running:
            # Returns early when the query ends and raises if it failed.
            running = [query for query in running if not query.awaitTermination(1)]
    finally:
        for query in running:
            query.stop()
