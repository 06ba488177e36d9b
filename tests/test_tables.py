from collections import Counter
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logmill.operators.serving import day_rows
from logmill.plans import catalog
from logmill.schema import QUARANTINE_FIELDS, ddl
from logmill.sources import shared
from logmill.sources.lines import (
    PUBLISH_OPTIONS,
    decode_records,
    publish_stream,
    read_text_lines,
    records,
    topic_options,
)
from logmill.sources.tables import exists, read_facts, read_quarantine, write_facts, write_load
from logmill.sources.versions import Table

from conftest import SMALL

from test_serving import COLUMNS, DAY, ROWS, fact


def files_of(spark, path, day):
    table = Table(spark, str(path))
    return [entry["path"] for entry in table.entries(table.latest(), str(day))]


def test_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame(ROWS, COLUMNS)
    for batch_id in (0, 1, 1, 0):
        write_facts(rows, path, "stream", batch_id)
    assert read_facts(spark, path).count() == 2 * len(ROWS)
    write_facts(rows, path, "other", 0)
    assert read_facts(spark, path).count() == 3 * len(ROWS)
    assert read_facts(spark, path).columns == rows.columns


def test_one_day_is_read_from_its_own_folder(spark, tmp_path):
    path = str(tmp_path / "facts")
    for batch_id in range(3):
        write_facts(spark.createDataFrame(ROWS, COLUMNS), path, "stream", batch_id)
    whole = read_facts(spark, path)
    for day in (DAY, "2023-09-11", "2023-09-12"):
        rows = read_facts(spark, path, day)
        assert rows.schema == whole.schema
        want = whole.where(F.col("process_date") == F.lit(str(day)).cast("date"))
        assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
        assert all(f"process_date={day}" in file for file in rows.inputFiles())


def test_clustered_write_keeps_rows_and_merges_files(spark, tmp_path):
    # One date holds nearly all rows.
    rows = [fact("10:00", 200, i) for i in range(3_000)]
    rows += [fact("10:00", 200, i, other) for i, other in enumerate([r[13] for r in ROWS[-2:]] * 20)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(8)
    write_facts(df, str(tmp_path / "loose"), "a", cluster=False)
    write_facts(df, str(tmp_path / "clustered"), "a")
    for name in ("loose", "clustered"):
        got = read_facts(spark, str(tmp_path / name))
        assert Counter(map(str, got.collect())) == Counter(map(str, df.collect()))
    small_day = ROWS[-1][13]
    assert len(files_of(spark, tmp_path / "loose", small_day)) > 1
    assert len(files_of(spark, tmp_path / "clustered", small_day)) == 1


def test_large_date_is_split_by_clustering(spark, tmp_path):
    rows = spark.range(300_000).selectExpr(
        "uuid() AS api", "DATE'2024-01-01' AS process_date"
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        write_facts(rows, str(tmp_path / "t"), "a")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(files_of(spark, tmp_path / "t", "2024-01-01")) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 300_000


def test_without_adaptive_execution_rows_are_not_gathered(spark, tmp_path):
    rows = spark.range(8_000, numPartitions=8).selectExpr("id", "DATE'2024-01-01' AS process_date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_facts(rows, str(tmp_path / "t"), "a")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(files_of(spark, tmp_path / "t", "2024-01-01")) == 8


def test_quarantine_batch_is_one_file(spark, tmp_path):
    rows = spark.range(80, numPartitions=8).selectExpr("cast(id AS string) AS raw", "'no_match' AS reason")
    write_load(rows, str(tmp_path / "t"), "a", cluster=True)
    assert len(files_of(spark, tmp_path / "t", "")) == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 80


def test_empty_batch(spark, tmp_path):
    path = str(tmp_path / "quarantine")
    empty = spark.createDataFrame([], "process_timestamp timestamp, raw string, reason string")
    write_load(empty, path, "stream", 0)
    assert read_quarantine(spark, path).count() == 0


def test_text_lines(spark, tmp_path):
    import gzip

    (tmp_path / "a.log").write_text("one\ntwo\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as out:
        out.write("three\n")
    for path in (str(tmp_path), f"{tmp_path}/*.log*", [f"{tmp_path}/a.log", f"{tmp_path}/b.log.gz"]):
        assert sorted(r.value for r in read_text_lines(spark, path).collect()) == ["one", "three", "two"]


def test_topic_options():
    assert topic_options("b:1,c:2", "logs", "earliest", maxOffsetsPerTrigger="9") == {
        "kafka.bootstrap.servers": "b:1,c:2",
        "subscribe": "logs",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "9",
    }
    assert PUBLISH_OPTIONS == {"kafka.acks": "all", "kafka.retries": "3"}


class FakeSession:
    def __init__(self, master, folder=None, mount=None):
        settings = {"spark.checkpoint.dir": folder, "spark.logmill.sharedMount": mount}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"{master}{folder}"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, other: settings.get(key) or other)})


def test_shared_folder_comes_from_the_session(monkeypatch):
    made = []
    monkeypatch.setattr(shared, "_make_for_session", lambda session, folder: made.append(folder))
    far = FakeSession("spark://host:7077", "hdfs://x/checkpoints/")
    folder = shared.shared_folder(far, "t")
    assert folder.startswith("hdfs://x/checkpoints/logmill-") and "/t-" in folder
    assert folder != shared.shared_folder(far, "t")
    assert shared.shared_folder(FakeSession("local[4]"), "t").startswith("file:///")
    assert len(made) == 2  # one folder per session
    for master, base in (("spark://host:7077", None), ("yarn", "file:/tmp/x"), ("yarn", "/tmp/x")):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_folder(FakeSession(master, base), "t")
    assert shared.shared_folder(FakeSession("yarn", "/mnt/x", "true"), "t").startswith("/mnt/x/")


def test_shared_folders_can_be_removed(spark, tmp_path):
    folder = shared.shared_folder(spark, "t")
    spark.range(3).write.parquet(folder)
    assert exists(spark, folder)
    shared.remove_folder(spark, folder)
    assert not exists(spark, folder)
    with pytest.raises(ValueError, match="not a folder"):
        shared.remove_folder(spark, str(tmp_path))


def test_rewrite_with_fewer_dates_leaves_only_its_rows(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame(ROWS, COLUMNS)
    dates = sorted({str(r[13]) for r in ROWS})
    assert len(dates) > 1
    write_facts(rows, path, "a", 0)
    write_facts(rows, path, "a", 1)
    fewer = rows.where(F.col("process_date") == dates[0])
    write_facts(fewer, path, "a", 0)
    assert read_facts(spark, path).count() == len(ROWS) + fewer.count()
    write_facts(rows.limit(0), path, "a", 0)
    assert read_facts(spark, path).count() == len(ROWS)
    write_facts(rows, path, "a", 0)
    assert read_facts(spark, path).count() == 2 * len(ROWS)


def test_rewrite_of_a_quarantine_without_rows(spark, tmp_path):
    path = str(tmp_path / "bad")
    rows = spark.createDataFrame([(None, "x", "no_match")], ddl(QUARANTINE_FIELDS))
    write_load(rows, path, "a", 0)
    write_load(rows, path, "a", 10)
    write_load(rows.limit(0), path, "a", 0)
    assert read_quarantine(spark, path).count() == 1


def test_a_missing_table_is_an_error_and_a_missing_day_is_not(spark, tmp_path):
    path = str(tmp_path / "facts")
    for day in (None, DAY):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            read_facts(spark, path, day)
    write_facts(spark.createDataFrame(ROWS, COLUMNS), path, "a")
    assert read_facts(spark, path, "1999-01-01").count() == 0
    day = date.fromisoformat(str(DAY))
    spellings = (day, datetime(day.year, day.month, day.day, 7, 5), day.isoformat(), day.strftime("%Y%m%d"))
    counts = {read_facts(spark, path, d).count() for d in spellings}
    counts |= {day_rows(read_facts(spark, path), d).count() for d in spellings}
    assert len(counts) == 1 and counts.pop() > 0
    with pytest.raises(ValueError):
        read_facts(spark, path, "yesterday")


@pytest.mark.parametrize("name", ["partition_day_scan", "stream_foreach_batch"])
def test_queries_that_write_leave_one_folder(spark, name):
    def size():
        made = [f.removeprefix("file://") for f in shared._folders.values()]
        return sum(len(list(Path(folder).iterdir())) for folder in made if Path(folder).exists())

    catalog.queries()[name](spark, SMALL).collect()
    before = size()
    catalog.queries()[name](spark, SMALL).collect()
    assert size() == before


def test_lines_are_published_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('one "1"\ntwo\n')
    lines = spark.readStream.text(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second run finds nothing new
        query = publish_stream(lines, "b:1", "logs", checkpoint, trigger={"availableNow": True}, connector="parquet", path=out)
        query.awaitTermination()
    sent = spark.read.parquet(out).selectExpr("timestamp_millis(0) AS timestamp", "value")
    decoded = [r.value for r in decode_records(records(sent)).collect()]
    assert sorted(decoded) == ['one "1"\n', "two\n"]
