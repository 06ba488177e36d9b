"""Log lines from text files and from message-topic records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logmill.functions.codec import decode_json_scalar, encode_json_scalar, payload_reason

# Delivery settings of published records.
PUBLISH_OPTIONS = {"kafka.acks": "all", "kafka.retries": "3"}


def read_text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row (``value``) per line of files, folders or globs, compressed or not."""
    return spark.read.text(path)


def stream_text_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files of a folder, and of those that come, as a stream.

    The stream's checkpoint has the log of files, so each is read once, also after a restart;
    files must appear whole.
    """
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def topic_options(
    brokers: str, topic: str, starting_offsets: str = "latest", **options: str
) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        **options,
    }


def read_topic(
    spark: SparkSession, brokers: str, topic: str, starting_offsets: str = "latest", **options: str
) -> DataFrame:
    """Stream of topic records. Pass ``maxOffsetsPerTrigger`` to bound a batch.

    Needs the Kafka connector on the class path.
    """
    source = spark.readStream.format("kafka")
    return source.options(**topic_options(brokers, topic, starting_offsets, **options)).load()


def records(source: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(process_timestamp, payload) of topic records (``timestamp``, ``value``)."""
    return source.selectExpr(
        *(keep or []), "timestamp AS process_timestamp", "CAST(value AS STRING) AS payload"
    )


def decode_records(recs: DataFrame) -> DataFrame:
    """Add ``value``, the decoded line, and ``payload_reason`` where there is none."""
    decoded = recs.withColumn("value", decode_json_scalar(F.col("payload")))
    return decoded.withColumn(
        "payload_reason", payload_reason(F.col("payload"), F.col("value"))
    )


def encode_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Replace ``line`` by ``payload``: the line, with its line end, as a JSON string."""
    encoded = encode_json_scalar(F.concat(F.col(line), F.lit("\n")))
    return lines.withColumn("payload", encoded).drop(line)


def _messages(lines: DataFrame, line: str) -> DataFrame:
    payload = encode_records(lines.select(line), line)
    return payload.select(F.col("payload").cast("binary").alias("value"))


def _publish_options(brokers: str, topic: str, options: dict[str, str]) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "topic": topic, **PUBLISH_OPTIONS, **options}


def publish(lines: DataFrame, brokers: str, topic: str, line: str = "value", **options: str) -> None:
    """Write every line to a topic, in parallel, as one batch. Needs the connector."""
    writer = _messages(lines, line).write.format("kafka")
    writer.options(**_publish_options(brokers, topic, options)).save()


def publish_stream(
    lines: DataFrame,
    brokers: str,
    topic: str,
    checkpoint: str,
    line: str = "value",
    trigger: dict | None = None,
    connector: str = "kafka",
    **options: str,
) -> StreamingQuery:
    """Send the lines of a stream to a topic as they come; each at least once.

    ``connector`` names another sink that takes a ``value`` column.
    """
    return (
        _messages(lines, line)
        .writeStream.format(connector)
        .outputMode("append")
        .options(**_publish_options(brokers, topic, options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
