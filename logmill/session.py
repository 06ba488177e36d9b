"""Session settings for stand-alone runs (an existing session works as well)."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins/aggregates at run time, split skewed and merge tiny partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Log time is reported in one explicit zone, never the machine's.
    "spark.sql.session.timeZone": "UTC",
    # Minute-rollup state lives on disk with an in-memory cache, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "logmill", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
