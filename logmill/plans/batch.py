"""The statistics of a log file or folder, from one parse."""

from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from logmill.operators import reports
from logmill.operators.parse import PERMISSIVE, good_rows, malformed_rows, parse_lines
from logmill.schema import LINE_FIELDS, ddl
from logmill.sources.lines import read_text_lines


class LogAnalysis:
    """Lazy reports; each is computed when shown, written or collected.

    Reports on codes share one pass over the rows, those on agents another: the counts
    they start from are kept. ``totals`` are the values of ``reports.totals``, if they were
    observed already: sizes and numbers of codes then need no pass. ``close``, or leaving a
    ``with`` block, releases all that is kept.
    """

    def __init__(
        self, parsed: DataFrame, malformed: DataFrame, kept: DataFrame | None = None, totals: dict | None = None
    ):
        self.parsed = parsed
        self.malformed = malformed
        self.totals = totals
        self._kept = [] if kept is None else [kept]

    def _keep(self, rows: DataFrame) -> DataFrame:
        self._kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return rows

    @cached_property
    def reports(self) -> dict[str, DataFrame]:
        codes = self._keep(reports.code_summary(self.parsed))
        agents = self._keep(reports.requests_per_user_agent(self.parsed))
        sizes = numbers = None
        if self.totals is not None:
            spark = self.parsed.sparkSession
            sizes = reports.content_size_from(spark, self.totals)
            numbers = reports.code_totals_from(spark, self.totals)
        return {
            "content size": sizes or reports.content_size_of(codes),
            "top response codes": reports.top_codes_of(codes),
            "response codes": numbers or reports.code_totals_of(codes),
            "top user agents": reports.top_agents_of(agents),
            "requests per user agent": agents,
            "requests per timestamp": reports.requests_per_timestamp(self.parsed),
            "requests per address": reports.requests_per_ip(self.parsed),
        }

    def close(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> "LogAnalysis":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def analyze(spark: SparkSession, path: str | list[str], store: str | None = None) -> LogAnalysis:
    """Parse ``path`` once and register the good rows as view ``logs``.

    With ``store``, good and malformed lines are written there as Parquet, in one pass
    over the text that also observes sizes and codes; every other report reads only the
    columns it names: the way for logs larger than memory. Without, the parsed rows are kept by the executors until the
    analysis is closed.
    """
    judged = parse_lines(read_text_lines(spark, path), mode=PERMISSIVE)
    if store is None:
        judged = judged.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        marked = judged.selectExpr("*", "reason IS NOT NULL AS is_malformed")
        # The write has no shuffle, so a task that runs again counts once.
        seen = Observation()
        marked = marked.observe(seen, *reports.totals(~F.col("is_malformed")))
        marked.write.mode("overwrite").partitionBy("is_malformed").parquet(store)
        layout = ddl(LINE_FIELDS, {"raw": "string", "reason": "string", "is_malformed": "boolean"})
        stored = spark.read.schema(layout).parquet(store)
        parsed = stored.where("NOT is_malformed").select(*LINE_FIELDS)
        parsed.createOrReplaceTempView("logs")
        return LogAnalysis(parsed, stored.where("is_malformed").select("raw", "reason"), totals=seen.get)
    parsed = good_rows(judged)
    parsed.createOrReplaceTempView("logs")
    return LogAnalysis(parsed, malformed_rows(judged), judged)
