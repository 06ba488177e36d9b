"""Merging the files that a day's batches have left, in one commit."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.clock import as_day
from logmill.schema import LOAD_FIELDS, ddl
from logmill.sources.tables import ZONE_COLUMNS, read_entries, write_files
from logmill.sources.versions import Change, Conflict, Table, Version, merge_loads

# Rows of a merged file, as a rule.
FILE_ROWS = 5_000_000


def compact(
    spark: SparkSession, table: str, day: str | date, fields: dict[str, str], file_rows: int = FILE_ROWS
) -> Version | None:
    """Merge all files of a day into few; safe to repeat, also after a failure.

    ``fields`` are the table's columns (``ENRICHED_FIELDS``, ``ROLLUP_FIELDS``, columns
    carried along first). Rows are laid out by time, so that each merged file covers a
    stretch of the day and a reader of an hour opens few; a minute with very many rows is
    split as well. Batches that arrive meanwhile stay beside the merged files. If one that
    is being merged is written again meanwhile, the merge starts over. None if there is
    nothing to merge.
    """
    day = str(as_day(day))
    while True:
        try:
            return _compact_once(spark, Table(spark, table), day, fields, file_rows)
        except Conflict:
            continue


def _compact_once(spark: SparkSession, table: Table, day: str, fields: dict[str, str], file_rows: int) -> Version | None:
    base = table.latest()
    entries = table.entries(base, day) if base else []
    count = max(1, -(-sum(e["rows"] for e in entries) // file_rows))
    if len(entries) <= count:
        return None
    data = {name: kind for name, kind in fields.items() if name != "process_date"}
    schema = ddl(data, {"process_date": "date"}, LOAD_FIELDS)
    rows = _laid_out(read_entries(spark, table.store.table, schema, entries), count)
    loads = merge_loads(e["loads"] for e in entries)
    merged = write_files(rows, table.store.table, ["process_date"], loads)
    paths = {e["path"] for e in entries}

    def change(latest: Version) -> Change:
        if not paths <= {e["path"] for e in table.entries(latest, day)}:
            raise Conflict(day)
        return Change(merged, {day: paths})

    return table.commit("compact", {}, change)


def _laid_out(rows: DataFrame, count: int) -> DataFrame:
    """Rows in ``count`` ranges of time."""
    zone = next((c for c in ZONE_COLUMNS if c in rows.columns), None)
    if count == 1 or zone is None:
        return rows.repartition(count)
    # The second key splits a single minute; equal keys are equal rows of it.
    salt = F.xxhash64(*[F.col(c) for c in rows.columns])
    return rows.repartitionByRange(count, F.col(zone), salt)
