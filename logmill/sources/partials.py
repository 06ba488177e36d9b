"""Figures over many days from partial figures of each day.

A day's partials hold the requests per user agent, address and response code, and the codes
that occur as bitmaps. They add up over days, exactly: figures over a month read a row per
day and key instead of the facts. Partials name the files they were made from, so a refresh
computes the days that have changed since, and no others.
"""

import hashlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.clock import as_day
from logmill.schema import ENRICHED_FIELDS, LOAD_FIELDS, ddl
from logmill.sources.tables import gather, read_entries, write_files
from logmill.sources.versions import Change, Entry, Table, Version

AGENT, ADDRESS, CODE, CODES = "user_agent", "ip_address", "response_code", "codes"
KEYS = (AGENT, ADDRESS, CODE)
PARTIAL_FIELDS = {
    "kind": "string",
    "key": "string",
    "total_requests": "bigint",
    "bucket": "bigint",
    "bits": "binary",
    "process_date": "date",
}


def day_partials(facts: DataFrame) -> DataFrame:
    """Per date and key, requests; per date and range of codes, the codes as a bitmap.

    NULL is a key like others. One pass counts by each key, and one reads the codes alone;
    both combine before the shuffle, so a key that fills a day is a row per task.
    """
    day = F.col("process_date")
    counted = facts.groupingSets([[day, F.col(k)] for k in KEYS], day, *[F.col(k) for k in KEYS]).agg(
        F.count("*").alias("total_requests"), F.grouping_id().alias("set")
    )
    # Of the set's bits, the first is the date's; a key that is not grouped by has a 1.
    kind = key = F
    for place, name in enumerate(KEYS):
        here = F.col("set").bitwiseAND(1 << (len(KEYS) - 1 - place)) == 0
        kind = kind.when(here, F.lit(name))
        key = key.when(here, F.col(name).cast("string"))
    counts = counted.select(
        kind.alias("kind"), key.alias("key"), "total_requests",
        F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "process_date",
    )
    codes = facts.groupBy("process_date", F.bitmap_bucket_number(F.col(CODE).cast("bigint")).alias("bucket")).agg(
        F.count("*").alias("total_requests"),
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(CODE).cast("bigint"))).alias("bits"),
    )
    codes = codes.select(
        F.lit(CODES).alias("kind"), F.lit(None).cast("string").alias("key"),
        "total_requests", "bucket", "bits", "process_date",
    )
    return counts.union(codes)


def _source(entries: list[Entry]) -> str:
    return hashlib.sha256("\n".join(sorted(e["path"] for e in entries)).encode()).hexdigest()


def _sources(version: Version | None, table: Table) -> dict[str, str]:
    """By date, the source that partials were made from."""
    found = table.all_entries(version) if version else {}
    return {day: entries[0]["source"] for day, entries in found.items() if entries}


def stale_days(spark: SparkSession, facts: str, partials: str) -> list[str]:
    """Days whose facts have changed since their partials were made, or that have none."""
    return sorted(_stale(Table(spark, facts), Table(spark, partials))[0])


def _stale(facts: Table, partials: Table) -> tuple[dict[str, list[Entry]], dict[str, str]]:
    """(files of each stale day, source of its partials)"""
    base = facts.latest()
    files = facts.all_entries(base) if base else {}
    now = {day: _source(entries) for day, entries in files.items()}
    made = _sources(partials.latest(), partials)
    stale = {day for day in {*now, *made} if now.get(day) != made.get(day)}
    return {day: files.get(day, []) for day in stale}, now


def refresh_partials(spark: SparkSession, facts: str, partials: str) -> list[str]:
    """Make the partials of stale days anew, in one commit; the days, ascending.

    Only their facts are read, as one version has them. A run that fails changes nothing; of
    two runs side by side the later commit stays, and what it has made from older facts is
    stale for the next. Merging a day's files makes it stale as well, though its figures stay.
    """
    source, target = Table(spark, facts), Table(spark, partials)
    stale, now = _stale(source, target)
    if not stale:
        return []
    rows = read_entries(spark, source.store.table, ddl(ENRICHED_FIELDS, LOAD_FIELDS), [e for es in stale.values() for e in es])
    made = gather(day_partials(rows), ["process_date"]).sortWithinPartitions("process_date", "kind", "key")
    added = write_files(made, target.store.table, ["process_date"], {})
    for day, entries in added.items():
        for entry in entries:
            entry["source"] = now[day]

    def change(base: Version) -> Change:
        return Change(dict(added), {day: {e["path"] for e in target.entries(base, day)} for day in stale})

    target.commit("refresh", {}, change)
    return sorted(stale)


def read_partials(
    spark: SparkSession, partials: str, first: str | date | None = None, last: str | date | None = None
) -> DataFrame:
    """Partials of the days from ``first`` to ``last``, both included; None is open."""
    table = Table(spark, partials)
    version = table.latest()
    low = "" if first is None else str(as_day(first))
    high = "9999-12-31" if last is None else str(as_day(last))
    days = [day for day in (version.days if version else {}) if low <= day <= high]
    lists = [name for day in sorted(days) for name in version.days[day]]
    entries = [e for found in table.read_lists(lists) for e in found]
    return read_entries(spark, table.store.table, ddl(PARTIAL_FIELDS), entries)


def _of(partials: DataFrame, kind: str) -> DataFrame:
    return partials.where(F.col("kind") == kind)


def _requests_per(partials: DataFrame, kind: str) -> DataFrame:
    return _of(partials, kind).groupBy(F.col("key").alias(kind)).agg(F.sum("total_requests").alias("total_requests"))


def requests_per_user_agent(partials: DataFrame) -> DataFrame:
    return _requests_per(partials, AGENT)


def requests_per_ip(partials: DataFrame) -> DataFrame:
    """Ascending, like the report over facts."""
    return _requests_per(partials, ADDRESS).orderBy("total_requests", ADDRESS)


def response_code_counts(partials: DataFrame) -> DataFrame:
    counted = _requests_per(partials, CODE).withColumnRenamed("total_requests", "total_count")
    return counted.withColumn(CODE, F.col(CODE).cast("int"))


def response_code_totals(partials: DataFrame) -> DataFrame:
    """Number of different codes, from the bitmaps, and of requests."""
    ranges = _of(partials, CODES).groupBy("bucket").agg(
        F.sum("total_requests").alias("total_requests"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("codes")
    )
    return ranges.agg(
        F.coalesce(F.sum("codes"), F.lit(0)).alias("distinct_codes"),
        F.coalesce(F.sum("total_requests"), F.lit(0)).alias("total_requests"),
    )
