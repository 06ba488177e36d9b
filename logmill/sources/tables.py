"""Versioned Parquet tables: enriched rows, rollups and quarantined lines.

Files lie in ``commit=/process_date=`` (no date for the quarantine) and count once a version
of the table names them; see ``versions``. Rows carry the batch they came from, so a batch
that is written again replaces its own rows and no others.
"""

from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmill.functions.clock import as_day
from logmill.schema import ENRICHED_FIELDS, LOAD_FIELDS, QUARANTINE_FIELDS, ddl
from logmill.sources.versions import Change, Entry, Ranges, Table, Version, in_ranges, inside_of, new_folder

_LOAD = list(LOAD_FIELDS)
_DATE = "process_date"
# Columns whose smallest and largest values are kept for each file, where a table has them.
ZONE_COLUMNS = ("process_timestamp", "minute", "log_timestamp", "response_code")

# Bounds of a column, both included; None is open.
Between = dict[str, tuple[Any, Any]]


def gather(rows: DataFrame, partition: list[str]) -> DataFrame:
    """Bring rows of a partition value together before they are written.

    A task writes one file per value it holds: many small files, when a batch has many
    tasks or mixes many dates. Adaptive execution sizes the gathered partitions, merging
    small ones and splitting a value that is too large for one task. Where it is off,
    one task would get everything of a value, so rows are left as they are.
    """
    adaptive = rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    return rows.hint("rebalance", *partition) if adaptive else rows


def write_load(
    rows: DataFrame,
    path: str,
    load_id: str,
    batch_id: int = 0,
    partition: list[str] | None = None,
    cluster: bool = False,
) -> Version:
    """Store ``rows`` as batch ``batch_id`` of ``load_id``, in one commit; safe to repeat.

    If the table holds the batch already, its rows are replaced, also those of dates that
    the new rows no longer have, and those in merged files. A reader finds the table before
    or after the commit, nothing between; a run that fails leaves it as it was.
    """
    if partition not in (None, [], [_DATE]):
        raise ValueError(f"tables have dates or nothing in front, not {partition}")
    spark, table = rows.sparkSession, Table(rows.sparkSession, path)
    _refuse_plain_folders(table)
    if cluster:
        rows = gather(rows, partition or [])
    rows = rows.withColumn("load_id", F.lit(load_id)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    own: dict[str, Ranges] = {load_id: [[batch_id, batch_id]]}
    added = write_files(rows, path, partition or [], own)
    others: dict[str, dict[str, list[Entry]]] = {}

    def change(base: Version) -> Change:
        """The new files, and those that held the batch without it."""
        wanted = Change(dict(added))
        if not in_ranges(base.loads.get(load_id, []), batch_id):
            return wanted
        for day, entries in table.all_entries(base).items():
            for entry in entries:
                if in_ranges(entry["loads"].get(load_id, []), batch_id):
                    wanted.removed.setdefault(day, set()).add(entry["path"])
                    if entry["loads"] != own:
                        if entry["path"] not in others:
                            kept = _without(read_entries(spark, path, rows.schema, [entry]), load_id, batch_id)
                            others[entry["path"]] = write_files(kept, path, partition or [], entry["loads"])
                        wanted.add(others[entry["path"]])
        return wanted

    return table.commit("write", own, change)


def _without(rows: DataFrame, load_id: str, batch_id: int) -> DataFrame:
    return rows.where((F.col("load_id") != load_id) | (F.col("batch_id") != batch_id))


def write_files(
    rows: DataFrame, path: str, partition: list[str], loads: dict[str, Ranges]
) -> dict[str, list[Entry]]:
    """Write rows to a folder of their own; entries of its files by date, '' without dates.

    One pass over the few zone columns of what was written gives row counts and zones.
    """
    spark, folder = rows.sparkSession, new_folder()
    rows.write.partitionBy(*partition).parquet(f"{path}/{folder}")
    zones = [c for c in ZONE_COLUMNS if c in rows.columns]
    found: dict[str, list[Entry]] = {}
    if partition and not Table(spark, path).store.list(f"{folder}/{_DATE}=*"):
        return found  # no rows, no files
    written = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
    bounds = [f(_plain(written, c)).alias(f"{name}_{c}") for c in zones for name, f in (("low", F.min), ("high", F.max))]
    for row in written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *bounds).collect():
        entry = {
            "path": inside_of(row["file"], folder),
            "rows": row["rows"],
            "low": {c: row[f"low_{c}"] for c in zones},
            "high": {c: row[f"high_{c}"] for c in zones},
            "loads": loads,
        }
        day = entry["path"].split("/")[1].removeprefix(f"{_DATE}=") if partition else ""
        found.setdefault(day, []).append(entry)
    return {day: sorted(entries, key=lambda e: e["path"]) for day, entries in found.items()}


def _plain(rows: DataFrame, column: str):
    """A column's values as JSON can hold them, in the same order."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    return F.col(column).cast("string") if isinstance(kind, T.TimestampNTZType) else F.col(column)


def _plain_bound(value: Any) -> Any:
    if isinstance(value, datetime):
        if value.tzinfo is None:
            return str(value)
        since = value.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
        return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds
    return str(value) if isinstance(value, date) else value


def may_hold(entry: Entry, between: Between) -> bool:
    """Whether a file may have rows with all columns within their bounds. A file whose values
    are all NULL has none; one without a zone for a column may."""
    for column, (low, high) in between.items():
        if column not in entry["low"]:
            continue
        least, most = entry["low"][column], entry["high"][column]
        if least is None:
            return False
        if low is not None and most < _plain_bound(low) or high is not None and least > _plain_bound(high):
            return False
    return True


def read_entries(spark: SparkSession, path: str, schema: str | T.StructType, entries: list[Entry]) -> DataFrame:
    """The rows of the listed files."""
    empty = spark.createDataFrame([], schema)
    if not entries:
        return empty
    files = [f"{path.rstrip('/')}/{entry['path']}" for entry in entries]
    return spark.read.schema(schema).option("basePath", path).parquet(*files).select(*empty.columns)


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_hadoop_path(spark, path))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path), _hadoop_path(spark, path)
    return fs.exists(place) and fs.getFileStatus(place).isDirectory()


def make_table(spark: SparkSession, path: str) -> str:
    """An empty table, if there is none: what a stream that finds no input leaves."""
    _file_system(spark, path).mkdirs(_hadoop_path(spark, path))
    return path


def _refuse_plain_folders(table: Table) -> None:
    """A folder of files without versions is somebody else's, or older than versions are."""
    if table.latest() is None and (table.store.list(f"{_DATE}=*") or table.store.list("load_id=*")):
        raise ValueError(f"{table.store.table} has files but no versions; write to a new folder")


def write_facts(
    facts: DataFrame, path: str, load_id: str, batch_id: int = 0, cluster: bool = True
) -> Version:
    """Store enriched rows by date. ``cluster=False`` saves the shuffle for input whose
    tasks are few, or large and of one date each."""
    return write_load(facts, path, load_id, batch_id, [_DATE], cluster)


def read_by_date(
    spark: SparkSession,
    path: str,
    schema: str,
    day: str | date | None = None,
    version: int | None = None,
    between: Between | None = None,
) -> DataFrame:
    """Rows of a table, of one day or all, as one version of it has them: the latest, or
    ``version``. Commits that come later change nothing in what this returns.

    ``between`` keeps rows whose columns lie within bounds; files whose zones lie outside
    are not opened, nor, with ``day``, are the lists of other days. A day without files has
    no rows; a table that does not exist, or a version that is not kept, is an error. The
    schema is declared, so no file is opened to infer it.
    """
    table, day = Table(spark, path), None if day is None else as_day(day)
    found = table.latest() if version is None else table.version(version)
    if found is None:
        if not exists(spark, path) or _is_plain(table):
            return spark.read.schema(schema).parquet(path)
        return spark.createDataFrame([], schema)
    if day is None:
        entries = [e for entries in table.all_entries(found).values() for e in entries]
    else:
        entries = table.entries(found, str(day))
    rows = read_entries(spark, path, schema, [e for e in entries if may_hold(e, between or {})])
    for column, (low, high) in (between or {}).items():
        if low is not None:
            rows = rows.where(F.col(column) >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(column) <= F.lit(high))
    return rows


def _is_plain(table: Table) -> bool:
    return bool(table.store.list("[!_.]*"))


def read_facts(
    spark: SparkSession, path: str, day: str | date | None = None, extra: dict[str, str] | None = None,
    version: int | None = None, between: Between | None = None,
) -> DataFrame:
    """Enriched rows. ``extra`` declares columns that were carried along in front."""
    schema = ddl(extra or {}, ENRICHED_FIELDS, LOAD_FIELDS)
    return read_by_date(spark, path, schema, day, version, between).drop(*_LOAD)


def read_quarantine(
    spark: SparkSession, path: str, extra: dict[str, str] | None = None, version: int | None = None
) -> DataFrame:
    schema = ddl(extra or {}, QUARANTINE_FIELDS, LOAD_FIELDS)
    return read_by_date(spark, path, schema, version=version).drop(*_LOAD)


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest version, to read several days of one state."""
    found = Table(spark, path).latest()
    return found and found.number


def vacuum(spark: SparkSession, path: str, keep_hours: float = 168) -> int:
    """Remove what no version of the last ``keep_hours`` needs; readers of older ones fail."""
    return len(Table(spark, path).vacuum(keep_hours * 3600))

