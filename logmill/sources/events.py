"""Log lines spelled from the ``events`` table, the input of the registered queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.clock import instant_of
from logmill.sources.lines import encode_records
from logmill.sources.synthetic import log_time
from logmill.sources.tables import exists, is_folder

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

# Method and status code per event type; others get the defaults.
METHODS = {"view": "GET", "click": "POST", "purchase": "PUT", "signup": "POST"}
STATUS_CODES = {"error": "500", "signup": "303", "purchase": "404"}
OTHER_METHOD, OTHER_STATUS = "DELETE", "200"
NO_SIZE_EVERY = 97  # every 97th event has "-" for its size, which does not parse


def _by_type(values: dict[str, str], other: str):
    choice = F
    for kind, value in values.items():
        choice = choice.when(F.col("event_type") == kind, F.lit(value))
    return choice.otherwise(F.lit(other))


def event_lines(events: DataFrame) -> DataFrame:
    """(event_id, process_timestamp, value): one line per event.

    The event time is both the time in the line and, as a UTC wall clock, the time
    the record reached the topic.
    """
    size = F.when(F.col("event_id") % NO_SIZE_EVERY == 0, F.lit("-")).otherwise(
        F.round(F.col("value") * 100).cast("bigint").cast("string")
    )
    user = F.col("user_id")
    line = F.concat(
        F.lit("10.0."), F.call_function("div", user, F.lit(256)).cast("string"), F.lit("."),
        (user % 256).cast("string"), F.lit(" - - ["), log_time(F.col("ts")), F.lit(' +0000] "'),
        _by_type(METHODS, OTHER_METHOD), F.lit(" /"), F.col("event_type"), F.lit(' HTTP/1.0" '),
        _by_type(STATUS_CODES, OTHER_STATUS), F.lit(" "), size, F.lit(' "-" "agent/'),
        (user % 10).cast("string"), F.lit('" '), (F.col("event_id") % 5000 + 1).cast("string"),
    )
    return events.select("event_id", F.col("ts").alias("process_timestamp"), line.alias("value"))


def read_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def event_records(events: DataFrame) -> DataFrame:
    """(event_id, timestamp, value): the lines as topic records."""
    encoded = encode_records(event_lines(events))
    return encoded.select(
        "event_id",
        instant_of(F.col("process_timestamp")).alias("timestamp"),
        F.col("payload").cast("binary").alias("value"),
    )


def read_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def stream_event_records(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """All records of the table as a stream, whether it is one file or a folder of files."""
    table = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(EVENTS_SCHEMA).options(**options)
    if is_folder(spark, table):
        return event_records(source.parquet(table))
    if not exists(spark, table):
        raise FileNotFoundError(f"no table to stream: {table}")
    return event_records(source.option("pathGlobFilter", "events.parquet").parquet(sf_dir))
