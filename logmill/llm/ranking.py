"""Positions of rows in the order of their groups, also of a group that holds most rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.common import stored


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` stored with ``pos``, from 0 on within ``group``, and ``total``, the group's rows.

    Rows are dealt out by ranges of (group, order), so a large group covers many tasks; each
    task's rows of a group follow each other, and one row for each group and task says how
    many come before. Equal rows spread by a number of their own. ``group`` has no NULLs.
    """
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")
    order = [F.col(group), *order, F.col("tie")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stored(laid.drop("tie").withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    # The upper bits of ``at`` are the task's number.
    laid = laid.withColumn("part", F.shiftright("at", 33))
    runs = laid.groupBy(F.col(group).alias("of"), F.col("part").alias("run")).agg(
        F.min("at").alias("start"), F.count("*").alias("n")
    )
    within = Window.partitionBy("of").orderBy("run")
    before = F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    runs = runs.select("of", "run", "start", before.alias("before"), F.sum("n").over(Window.partitionBy("of")).alias("total"))
    met = laid.join(runs, (F.col(group) == F.col("of")) & (F.col("part") == F.col("run")))
    return met.withColumn("pos", F.col("at") - F.col("start") + F.col("before")).drop(
        "of", "run", "start", "before", "at", "part"
    )
