from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from logmill.functions.clock import instant_of, minute_label, today, wall_clock
from logmill.operators.enrich import enrich
from logmill.operators.parse import DROPMALFORMED, parse_lines
from logmill.schema import ENRICHED_FIELDS

ZONES = ["UTC", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe"]


def enriched(spark, line, record_time="2023-09-10T20:00:30.5Z", zone="UTC"):
    df = spark.createDataFrame([(line,)], "value string").withColumn(
        "process_timestamp", F.lit(record_time).cast("timestamp")
    )
    rows = enrich(parse_lines(df, mode=DROPMALFORMED), zone=zone)
    assert rows.columns == list(ENRICHED_FIELDS)
    assert dict(rows.dtypes) == ENRICHED_FIELDS
    return rows.withColumn("log_timestamp", wall_clock(F.col("log_timestamp"))).first()


@pytest.mark.parametrize("session", ZONES)
def test_times(spark, session_zone, valid_line, session):
    session_zone(session)
    row = enriched(spark, valid_line)
    assert row.log_timestamp == datetime(2023, 9, 10, 7, 4, 56)
    assert row.process_timestamp == "2023-09-10 20:00"
    assert row.process_date == date(2023, 9, 10)
    row = enriched(spark, valid_line, zone="Asia/Kolkata")
    assert row.process_timestamp == "2023-09-11 01:30"
    assert row.process_date == date(2023, 9, 11)


@pytest.mark.parametrize("session", ZONES)
def test_clock_change_hours(spark, session_zone, session):
    # The repeated and the skipped hour in New York, both hours of each.
    session_zone(session)
    stamps = ["2024-11-03 05:30:00", "2024-11-03 06:30:00", "2024-03-10 06:30:00", "2024-03-10 07:30:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").withColumn(
        "utc", F.col("s").cast("timestamp_ntz")
    )
    row = df.select(
        "s",
        minute_label(wall_clock(instant_of(F.col("utc")))).alias("utc_back"),
        minute_label(wall_clock(instant_of(F.col("utc")), "America/New_York")).alias("local"),
    ).collect()
    assert [r.utc_back for r in row] == [s[:16] for s in stamps]
    assert [r.local for r in row] == [
        "2024-11-03 01:30", "2024-11-03 01:30", "2024-03-10 01:30", "2024-03-10 03:30",
    ]


def test_wall_clock_record_time_is_kept(spark, valid_line):
    df = spark.createDataFrame([(valid_line,)], "value string").withColumn(
        "process_timestamp", F.lit("2024-01-05 23:59:59").cast("timestamp_ntz")
    )
    row = enrich(parse_lines(df, mode=DROPMALFORMED)).first()
    assert (row.process_timestamp, row.process_date) == ("2024-01-05 23:59", date(2024, 1, 5))


@pytest.mark.parametrize(
    ("request_text", "parts"),
    [
        ("GET /usr HTTP/1.0", ("GET", "/usr", "HTTP/1.0")),
        ("-", ("-", None, None)),
        ("", ("", None, None)),
        ("GET /a b HTTP/1.0", ("GET", "/a", "b")),
        ("GET  /a", ("GET", "", "/a")),
    ],
)
def test_request_parts(spark, valid_line, request_text, parts):
    row = enriched(spark, valid_line.replace("GET /usr HTTP/1.0", request_text))
    assert (row.request_type, row.api, row.protocol) == parts


def test_bad_log_time_keeps_the_row(spark, valid_line):
    row = enriched(spark, valid_line.replace("10/Sep/2023:12:34:56 +0530", "nope"))
    assert row.log_timestamp is None
    assert row.response_code == 200


def test_columns_that_were_not_parsed_are_left_out(spark, valid_line):
    df = spark.createDataFrame([(1, valid_line)], "id int, value string").withColumn(
        "process_timestamp", F.lit("2024-01-05 23:59:59").cast("timestamp_ntz")
    )
    rows = enrich(parse_lines(df, fields=["response_code"], mode=DROPMALFORMED))
    assert rows.columns == ["id", "response_code", "process_timestamp", "process_date"]


def test_today_is_the_zones_date():
    assert (today("Pacific/Kiritimati") - today("Etc/GMT+12")).days in (1, 2)
