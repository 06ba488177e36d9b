"""Every registered query: (spark, table folder) to DataFrame.

The input is the ``events`` table, spelled as log lines or as topic records. Each
query reads it whole. Times are returned as UTC wall clocks and dates as
``yyyy-MM-dd``, so that results do not depend on the session zone.

Queries that store rows do so in a folder of their own for each call, which stays at least as
long as the result is held: it can be read however often the query is made again.
"""

import weakref
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.clock import minute_label, parse_log_time, wall_clock
from logmill.functions.codec import decode_json_scalar, encode_json_scalar
from logmill.functions.request import request_parts
from logmill.operators import reports, serving
from logmill.operators.enrich import enrich
from logmill.operators.parse import DROPMALFORMED, PERMISSIVE, malformed_rows, parse_lines
from logmill.schema import ENRICHED_FIELDS, LINE_FIELDS, ddl
from logmill.sources import partials
from logmill.sources.events import read_event_lines, read_event_records, stream_event_records
from logmill.sources.lines import decode_records, records
from logmill.sources.shared import remove_folder, shared_folder
from logmill.sources.tables import make_table, read_facts, read_quarantine, write_facts
from logmill.streaming.pipelines import (
    DRAIN,
    append_to_parquet,
    await_streams,
    fact_writer,
    fan_out,
    quarantine_writer,
    read_appended,
)
from logmill.streaming.rollup import read_rollup, update_rollup

DAY = "2024-01-05"

_EVENT_ID = {"event_id": "bigint"}


def _parsed(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    lines = read_event_lines(spark, sf_dir)
    return parse_lines(lines, fields=list(fields) or None, mode=DROPMALFORMED)


def _facts(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return enrich(_parsed(spark, sf_dir, *fields))


def parse_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("event_id", *LINE_FIELDS)


def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = parse_lines(read_event_lines(spark, sf_dir), mode=PERMISSIVE)
    return malformed_rows(judged).select("event_id", "raw", "reason")


def preview_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["ip_address", "response_code"]
    return reports.preview(_parsed(spark, sf_dir, *columns), "event_id", columns)


def kafka_record_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_records(records(read_event_records(spark, sf_dir)))
    return decoded.select(
        wall_clock(F.col("process_timestamp")).alias("process_timestamp"), "value"
    )


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("value", F.lit("\n"))
    return read_event_lines(spark, sf_dir).select(
        "event_id", encode_json_scalar(line).alias("payload")
    )


def json_scalar_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select(
        "event_id", decode_json_scalar(F.col("payload")).alias("line")
    )


def log_timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    instant = parse_log_time(F.col("log_timestamp"))
    return _parsed(spark, sf_dir, "log_timestamp").select(
        "event_id", wall_clock(instant).alias("log_ts_utc")
    )


def request_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "request").select(
        "event_id", *request_parts(F.col("request"))
    )


def minute_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.col("process_timestamp")
    return read_event_lines(spark, sf_dir).select(
        "event_id",
        minute_label(clock).alias("process_timestamp"),
        clock.cast("date").cast("string").alias("process_date"),
    )


def _date_label(rows: DataFrame, column: str = "process_date") -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("string"))


def _zone_free(rows: DataFrame) -> DataFrame:
    return _date_label(rows.withColumn("log_timestamp", wall_clock(F.col("log_timestamp"))))


def enriched_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zone_free(_facts(spark, sf_dir))


# Results and their folders: (application, query, table folder) -> those that may be in use.
_results: dict[tuple[str, str, str], list[tuple[weakref.ref[DataFrame], str]]] = {}


def _with_folder(name: str):
    """Give a query a new folder for its tables. Those of its earlier calls on the same input go
    with the next call, but for results that are still held; hold a result as long as
    anything that is derived from it is used."""

    def wrap(query: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            kept = _results.setdefault((spark.sparkContext.applicationId, name, sf_dir), [])
            for entry in [entry for entry in kept if entry[0]() is None]:
                remove_folder(spark, entry[1])
                kept.remove(entry)
            folder = shared_folder(spark, name)
            result = query(spark, sf_dir, folder)
            kept.append((weakref.ref(result), folder))
            return result

        return run

    return wrap


@_with_folder("facts")
def partition_day_scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Store the enriched rows by date, then read one date back."""
    write_facts(_facts(spark, sf_dir), table, load_id="events")
    stored = read_facts(spark, table, DAY, _EVENT_ID)
    rows = serving.day_rows(stored, DAY).select("event_id", "process_date", "response_code")
    return _date_label(rows)


def _stored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(stream_event_records(spark, sf_dir), keep=["event_id"])


@_with_folder("append")
def stream_parse_append(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    query = append_to_parquet(
        _stored_stream(spark, sf_dir), f"{folder}/facts", f"{folder}/checkpoint", DRAIN
    )
    await_streams(query)
    return _zone_free(read_appended(spark, f"{folder}/facts", extra=_EVENT_ID))


@_with_folder("fan-out")
def stream_foreach_batch(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    query = fan_out(
        _stored_stream(spark, sf_dir),
        [fact_writer(make_table(spark, f"{folder}/facts"))],
        [quarantine_writer(make_table(spark, f"{folder}/quarantine"))],
        f"{folder}/checkpoint",
        DRAIN,
    )
    await_streams(query)
    good = read_facts(spark, f"{folder}/facts", extra=_EVENT_ID)
    bad = read_quarantine(spark, f"{folder}/quarantine", _EVENT_ID)
    return good.select("event_id", F.lit(False).alias("is_malformed")).union(
        bad.select("event_id", F.lit(True))
    )


@_with_folder("rollup")
def stream_minute_rollup(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    query = update_rollup(
        _stored_stream(spark, sf_dir), make_table(spark, f"{folder}/minutes"),
        f"{folder}/checkpoint", DRAIN,
    )
    await_streams(query)
    return read_rollup(spark, f"{folder}/minutes").select(
        "minute", "response_code", "total_count", "output_bytes"
    )


def _of_partials(figure: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @_with_folder(f"partials-{figure.__name__}")
    def query(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
        """Store the enriched rows by date and the partials of each day; a figure of all days."""
        write_facts(_facts(spark, sf_dir), f"{folder}/facts", load_id="events")
        partials.refresh_partials(spark, f"{folder}/facts", f"{folder}/partials")
        return figure(partials.read_partials(spark, f"{folder}/partials"))

    return query


def _over_logs_view(statement: str, field: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _parsed(spark, sf_dir, field).createOrReplaceTempView("logs")
        return spark.sql(statement)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of_parsed(report, *fields):
        return lambda spark, sf_dir: report(_parsed(spark, sf_dir, *fields))

    def of_day(figure, *fields):
        return lambda spark, sf_dir: figure(_facts(spark, sf_dir, *fields), DAY)

    code, size = "response_code", "response_bytes"
    return {
        "parse_log_lines": parse_log_lines,
        "malformed_lines": malformed_lines,
        "preview_parsed": preview_parsed,
        "kafka_record_decode": kafka_record_decode,
        "json_scalar_encode": _payloads,
        "json_scalar_decode": json_scalar_decode,
        "log_timestamp_parse": log_timestamp_parse,
        "request_split": request_split,
        "minute_bucket": minute_bucket,
        "enriched_log": enriched_log,
        "content_size_stats": of_parsed(reports.content_size_stats, size),
        "response_code_counts": of_parsed(reports.response_code_counts, code),
        "top_response_codes": of_parsed(reports.top_response_codes, code),
        "response_code_totals": of_parsed(reports.response_code_totals, code),
        "top_user_agents": of_parsed(reports.top_user_agents, "user_agent"),
        "requests_per_user_agent": _over_logs_view(
            "SELECT user_agent, count(*) AS total_requests FROM logs GROUP BY user_agent",
            "user_agent",
        ),
        "requests_per_timestamp": of_parsed(reports.requests_per_timestamp, "log_timestamp"),
        "requests_per_ip": of_parsed(reports.requests_per_ip, "ip_address"),
        "partition_day_scan": partition_day_scan,
        "day_has_data": of_day(
            lambda facts, day: _date_label(serving.day_has_data(facts, day), "day"), code
        ),
        "response_codes_by_minute": of_day(serving.response_codes_by_minute, code),
        "output_bytes_by_minute": of_day(serving.output_bytes_by_minute, size),
        "total_requests_by_minute": of_day(serving.total_requests_by_minute, code),
        "response_code_distribution": of_day(serving.response_code_distribution, code),
        "serving_rows_json": of_day(
            lambda facts, day: serving.rows_as_json(serving.total_requests_by_minute(facts, day)),
            code,
        ),
        "days_response_code_totals": _of_partials(partials.response_code_totals),
        "days_requests_per_user_agent": _of_partials(partials.requests_per_user_agent),
        "days_requests_per_ip": _of_partials(partials.requests_per_ip),
        "stream_parse_append": stream_parse_append,
        "stream_foreach_batch": stream_foreach_batch,
        "stream_minute_rollup": stream_minute_rollup,
    }
