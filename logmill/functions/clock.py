"""Time columns that do not depend on the session time zone."""

from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: time format inside a log line's brackets.
LOG_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def wall_clock(instant: Column, zone: str = "UTC") -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) of an instant in ``zone``.

    Counts microseconds from the epoch instead of casting through the session
    zone, where the repeated hour of a clock change would be ambiguous.
    """
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))
    if zone == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def instant_of(utc_wall_clock: Column) -> Column:
    """Instant (TIMESTAMP) of a UTC wall-clock time, whatever the session zone."""
    return F.concat(utc_wall_clock.cast("string"), F.lit("Z")).cast("timestamp")


def record_clock(df: DataFrame, column: str, zone: str = "UTC") -> Column:
    """Wall clock of a record-time column; a TIMESTAMP_NTZ column already is one."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.col(column)
    return wall_clock(F.col(column), zone)


def minute_label(clock: Column) -> Column:
    """``yyyy-MM-dd HH:mm``."""
    return F.substring(clock.cast("string"), 1, 16)


def today(zone: str = "UTC") -> date:
    return datetime.now(ZoneInfo(zone)).date()


def as_day(day: str | date) -> date:
    """A date, the date of a datetime, ``yyyy-mm-dd`` or ``yyyymmdd``."""
    if isinstance(day, str):
        return date.fromisoformat(day)
    return day.date() if isinstance(day, datetime) else day


def parse_log_time(text: Column) -> Column:
    """Instant of a log line's time; NULL where the text is not one."""
    return F.try_to_timestamp(text, F.lit(LOG_TIME_FORMAT))
