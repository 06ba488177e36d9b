"""Writers of micro-batches: versioned tables, the console, any connector."""

import threading
import uuid
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.sources.tables import write_facts, write_load
from logmill.sources.versions import Change, Table, in_ranges

# (rows, load id, batch number)
Writer = Callable[[DataFrame, str, int], None]

ROW_KEY = "row_key"
# Copies of one row that a task makes at once.
_COPIES = 4096
# A ledger's old versions go every so many batches.
_TIDY = 100
_HOUR = 3600


def fact_writer(path: str, cluster: bool = True) -> Writer:
    def write(rows: DataFrame, load_id: str, batch_id: int) -> None:
        write_facts(rows, path, load_id, batch_id, cluster)

    return write


def quarantine_writer(path: str, cluster: bool = True) -> Writer:
    def write(rows: DataFrame, load_id: str, batch_id: int) -> None:
        write_load(rows, path, load_id, batch_id, cluster=cluster)

    return write


def console_writer(rows: int = 20) -> Writer:
    """Show each batch's first rows on the driver, next to the tables it goes to."""

    def write(batch: DataFrame, load_id: str, batch_id: int) -> None:
        print(f"batch {batch_id}")
        batch.show(rows, truncate=False)

    return write


class Ledger:
    """Which batches of which loads a sink has taken whole. Kept as ranges, so its size does
    not grow with the batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.book = Table(spark, path)

    def has(self, load_id: str, batch_id: int) -> bool:
        known = self.book.latest()
        return known is not None and in_ranges(known.loads.get(load_id, []), batch_id)

    def enter(self, load_id: str, batch_id: int) -> None:
        known = self.book.commit("append", {load_id: [[batch_id, batch_id]]}, lambda base: Change({}))
        if known.number % _TIDY == 0:
            self.book.vacuum(_HOUR)


def with_row_keys(rows: DataFrame, load_id: str, batch_id: int, identity: list[str] | None = None) -> DataFrame:
    """The rows with ``row_key``, the same for the same batch however it is dealt out.

    ``identity`` names columns that tell a record, such as a topic's partition and offset.
    Without, the key is of all columns and a number among equal rows: these are counted,
    combined before the shuffle, and made again from the count, so that a row that fills
    most of a batch costs no more than others; its copies are spread over the tasks.
    """
    columns = rows.columns
    place = [F.lit(load_id).alias("load"), F.lit(batch_id).alias("batch")]

    def key(*parts):
        return F.sha2(F.to_json(F.struct(*place, *parts), {"timeZone": "UTC"}), 256).alias(ROW_KEY)

    if identity:
        return rows.select(*columns, key(*identity))
    whole = F.struct(*columns).alias("whole")
    counted = rows.groupBy(whole).agg(F.count("*").alias("copies"))
    # NULLs are part of the key; to_json leaves them out of a struct but keeps their columns apart.
    parts = counted.select("whole", "copies", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {_COPIES}"))).alias("part"))
    parts = parts.repartition("whole", "part")
    first = F.col("part") * _COPIES
    numbers = F.sequence(first, F.least(first + _COPIES, F.col("copies")) - 1)
    return parts.select("whole", F.explode(numbers).alias("number")).select("whole.*", key("whole", "number"))


def connector_writer(
    source: str, ledger: str | None = None, identity: list[str] | None = None, **options: str
) -> Writer:
    """Append through any connector.

    With ``ledger``, a folder of this sink's own, a batch that has been appended whole is not
    appended again, and rows carry ``row_key``: a batch that failed half way, or whose entry
    was lost with the driver, is appended again under the same keys, so that a target which
    upserts by them keeps each row once. Without, a retried batch is appended again.
    """

    def write(rows: DataFrame, load_id: str, batch_id: int) -> None:
        book = None if ledger is None else Ledger(rows.sparkSession, ledger)
        if book is not None:
            if book.has(load_id, batch_id):
                return
            rows = with_row_keys(rows, load_id, batch_id, identity)
        rows.write.format(source).mode("append").options(**options).save()
        if book is not None:
            book.enter(load_id, batch_id)

    return write


def side_by_side(spark: SparkSession, jobs: list[Callable[[], None]]) -> None:
    """Run the jobs at the same time. When one fails, Spark jobs of the others are cancelled
    and its error is raised once all have ended."""
    if len(jobs) == 1:
        return jobs[0]()
    context, tag, errors = spark.sparkContext, f"logmill-{uuid.uuid4().hex}", []

    def run(job: Callable[[], None]) -> None:
        context.addJobTag(tag)
        try:
            job()
        except BaseException as error:
            errors.append(error)
        finally:
            context.removeJobTag(tag)

    threads = [threading.Thread(target=inheritable_thread_target(spark)(run), args=(job,), daemon=True) for job in jobs]
    for thread in threads:
        thread.start()
    for thread in threads:
        while thread.is_alive():
            thread.join(0.1)
            # A job that another starts after the failure is cancelled as well.
            if errors:
                context.cancelJobsWithTag(tag)
    if errors:
        raise errors[0]
    return None
