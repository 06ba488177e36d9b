"""Rows in, bad and left out over the whole life of a stream, restarts included.

A query's own progress reaches back a hundred batches. Accounts listen to every batch's
progress and keep the sums, with the number of the last batch in them, in a folder.
"""

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from logmill.sources.versions import Store

_METRICS = "logmill"
_KEPT = 2


@dataclass(frozen=True)
class Account:
    """Sums over ``batches`` batches up to ``last``. ``bad`` are records that did not parse,
    ``left_out`` rows that came later than the watermark. If ``batches`` is less than
    ``last`` + 1, the driver was lost between a batch's end and its report."""

    last: int = -1
    batches: int = 0
    rows_in: int = 0
    bad: int = 0
    left_out: int = 0

    def plus(self, batch: int, rows_in: int, bad: int, left_out: int) -> "Account":
        return Account(batch, self.batches + 1, self.rows_in + rows_in, self.bad + bad, self.left_out + left_out)


def counted(judged: DataFrame) -> DataFrame:
    """Judged records whose bad ones are counted as they pass, without a job of its own."""
    return judged.observe(_METRICS, F.count("reason").alias("bad"))


class Accounts(StreamingQueryListener):
    """Accounts of all queries of a session, kept in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store, self.known = spark, Store(spark, folder), {}

    def of(self, query_id: str) -> Account:
        """A query's account; its id lives in the checkpoint, so restarts share it."""
        query_id = str(query_id)
        if query_id not in self.known:
            files = self.store.list(f"{query_id}/*.json")
            self.known[query_id] = Account(**json.loads(self.store.read(f"{query_id}/{files[-1][0]}"))) if files else Account()
        return self.known[query_id]

    def settle(self) -> None:
        """Wait until all that has happened is in the books."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        # What another driver may have added.
        self.known.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        query_id, before = str(progress.id), self.of(progress.id)
        if progress.batchId <= before.last:
            return
        observed = progress.observedMetrics.get(_METRICS)
        now = before.plus(
            progress.batchId,
            progress.numInputRows,
            observed["bad"] if observed else 0,
            sum(o.numRowsDroppedByWatermark for o in progress.stateOperators),
        )
        self.store.publish(f"{query_id}/{now.last:020d}.json", json.dumps(asdict(now)))
        self.known[query_id] = now
        for name, _ in self.store.list(f"{query_id}/*.json")[:-_KEPT]:
            self.store.remove(f"{query_id}/{name}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def keep_accounts(spark: SparkSession, folder: str) -> Accounts:
    """Start accounts; before the queries whose batches are to be counted."""
    accounts = Accounts(spark, folder)
    spark.streams.addListener(accounts)
    return accounts
