from collections import Counter

import pytest
from pyspark.sql import functions as F

from logmill.__main__ import main
from logmill.schema import ENRICHED_FIELDS
from logmill.sources import compact as cp
from logmill.sources import tables, versions
from logmill.sources.tables import read_facts, write_facts
from logmill.streaming.rollup import ROLLUP_FIELDS, read_rollup, rollup_writer

from test_serving import COLUMNS, DAY, ROWS, fact
from test_tables import files_of

BATCHES = 6


def contents(rows):
    return Counter(map(str, rows.collect()))


def batch(spark, number):
    return spark.createDataFrame([fact("10:00", 200 + number, number), *ROWS[-2:]], COLUMNS)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "facts")
    for number in range(BATCHES):
        write_facts(batch(spark, number), path, "s", number)
    return path


def test_many_batches_become_few_files(spark, table):
    before = contents(read_facts(spark, table))
    main(["compact", table, "--day", str(DAY)])
    assert len(files_of(spark, table, DAY)) == 1
    for _ in range(2):
        assert contents(read_facts(spark, table)) == before
        assert contents(read_facts(spark, table, DAY)) == contents(read_facts(spark, table).where(F.col("process_date") == F.lit(str(DAY)).cast("date")))
        assert cp.compact(spark, table, DAY, ENRICHED_FIELDS) is None
    write_facts(batch(spark, 50), table, "s", 50)
    cp.compact(spark, table, DAY, ENRICHED_FIELDS)
    assert len(files_of(spark, table, DAY)) == 1
    assert contents(read_facts(spark, table)) == before + contents(batch(spark, 50))


def test_a_batch_written_again_replaces_its_merged_rows(spark, table):
    before = contents(read_facts(spark, table))
    cp.compact(spark, table, DAY, ENRICHED_FIELDS)
    write_facts(batch(spark, 3), table, "s", 3)
    assert contents(read_facts(spark, table)) == before
    write_facts(batch(spark, 3).limit(0), table, "s", 3)
    assert contents(read_facts(spark, table)) == before - contents(batch(spark, 3))


def test_merged_files_each_cover_a_stretch_of_the_day(spark, tmp_path):
    path = str(tmp_path / "facts")
    for number in range(16):
        rows = [fact(f"{(i * 7) % 24:02}:{(i + number) % 60:02}", 200, i) for i in range(100)]
        rows += [fact("12:00", 200, i) for i in range(100)]  # half of all in one minute
        write_facts(spark.createDataFrame(rows, COLUMNS), path, "s", number)
    before = contents(read_facts(spark, path))
    cp.compact(spark, path, DAY, ENRICHED_FIELDS, file_rows=250)
    assert contents(read_facts(spark, path)) == before
    table = versions.Table(spark, path)
    entries = table.entries(table.latest(), str(DAY))
    assert len(entries) == 13 and max(e["rows"] for e in entries) < 600
    hour = (f"{DAY} 03:00", f"{DAY} 03:59")
    opened = read_facts(spark, path, DAY, between={"process_timestamp": hour})
    assert len(opened.inputFiles()) <= 2
    want = read_facts(spark, path, DAY).where(F.col("process_timestamp").between(*hour))
    assert contents(opened) == contents(want) and not opened.isEmpty()


class Lost(Exception):
    pass


def steps_of(monkeypatch, act):
    """Call ``act(step)`` before every step of a commit: lists and versions, the write and
    the pass over what was written."""
    count, busy = [0], []

    def before(owner, name):
        real = getattr(owner, name)

        def step(*args, **options):
            if not busy:
                busy.append(True)
                try:
                    count[0] += 1
                    act(count[0])
                finally:
                    busy.pop()
            return real(*args, **options)

        monkeypatch.setattr(owner, name, step)

    before(versions.Store, "publish")
    before(versions.Table, "latest")
    before(cp, "read_entries")
    before(cp, "write_files")
    before(tables, "write_files")
    before(tables, "inside_of")
    return count


JOBS = {
    "write": lambda spark, path: write_facts(batch(spark, 70), path, "t", 0),
    "rewrite": lambda spark, path: write_facts(batch(spark, 70), path, "s", 1),
    "compact": lambda spark, path: cp.compact(spark, path, DAY, ENRICHED_FIELDS),
}


@pytest.mark.parametrize("job,merged", [("write", False), ("rewrite", True), ("compact", False)])
def test_crash_and_late_batch_and_reader_at_every_step(spark, tmp_path, job, merged):
    """A job dies at its nth step, a batch having come and a reader having read at each step
    before. Nothing is lost or doubled, and every read is a whole version."""
    step = finished = 0
    while not finished:
        step += 1
        path = str(tmp_path / f"{job}-{step}")
        for number in range(3):
            write_facts(batch(spark, number), path, "s", number)
        if merged:
            cp.compact(spark, path, DAY, ENRICHED_FIELDS)
            write_facts(batch(spark, 3), path, "s", 3)
        own = [0, 1, 2, *([3] if merged else [])]
        late: list[int] = []

        def whole(rewritten):
            kept = [n for n in own if not (rewritten and job == "rewrite" and n == 1)]
            kept += [70] if rewritten and job != "compact" else []
            return Counter(
                line for n in [*kept, *late] for line in map(str, batch_rows[n])
            )

        batch_rows = {n: batch(spark, n).collect() for n in (*own, 70, *range(80, 84))}
        with pytest.MonkeyPatch.context() as patch:

            def act(at):
                if at == step:
                    raise Lost
                if at < step - 2:
                    return  # as in an earlier round
                assert contents(read_facts(spark, path)) in (whole(False), whole(True))
                if len(late) < 4:  # two commits come just before the crash
                    late.append(80 + len(late))
                    write_facts(batch(spark, late[-1]), path, "u", len(late))

            steps_of(patch, act)
            try:
                JOBS[job](spark, path)
                finished = True
            except Lost:
                pass
        got = contents(read_facts(spark, path))
        assert got == whole(bool(finished)) or (not finished and got == whole(True))
        JOBS[job](spark, path)
        assert contents(read_facts(spark, path)) == whole(True)
        assert contents(read_facts(spark, path, DAY)) == Counter(
            {line: n for line, n in whole(True).items() if f"{DAY} " in line}
        )
    assert step >= 5


def test_rollup(spark, tmp_path):
    path = str(tmp_path / "minutes")
    for number in range(4):
        rollup_writer(path)(batch(spark, number), "s", number)
    before = contents(read_rollup(spark, path))
    cp.compact(spark, path, DAY, ROLLUP_FIELDS)
    assert contents(read_rollup(spark, path)) == before
    rollup_writer(path)(batch(spark, 2), "s", 2)
    assert contents(read_rollup(spark, path)) == before and contents(read_rollup(spark, path, DAY))


def test_days_without_batches(spark, table):
    before = contents(read_facts(spark, table))
    assert cp.compact(spark, table, "1999-01-01", ENRICHED_FIELDS) is None
    assert contents(read_facts(spark, table)) == before
