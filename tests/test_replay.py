import threading
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logmill.__main__ import main
from logmill.operators.parse import good_rows, malformed_rows
from logmill.operators.enrich import enrich
from logmill.sources.tables import read_facts, read_quarantine, write_facts, write_load
from logmill.sources.versions import Store, Table
from logmill.streaming import replay as rp
from logmill.streaming.pipelines import DRAIN, await_streams, fact_writer, fan_out, judge_records, quarantine_writer
from logmill.streaming.replay import judge_again, replay

from conftest import VALID
from test_streaming import payload, topic  # noqa: F401

NEW = "new:" + VALID
RECORDS = [
    # batch 0, then 1, then 2
    [VALID, "junk", NEW.replace("200 4988", "201 1"), None],
    [NEW.replace("200 4988", "202 1")] * 2 + ["junk"],
    [NEW.replace("200 4988", "203 1"), VALID],
]


def spoilt(line):
    """A line of tomorrow's layout, which today's parser does not know."""
    return line.replace("new:", "new:~").replace('"GET', "'GET") if line and line.startswith("new:") else line


def judged(spark, number):
    at = datetime(2024, 1, 5, 10, number)
    lines = [(at, spoilt(line)) for line in RECORDS[number]]
    recs = spark.createDataFrame(lines, "process_timestamp timestamp, line string")
    return judge_records(recs.withColumn("payload", F.to_json(F.col("line").cast("variant"))).drop("line"))


def mended(bad):
    """Tomorrow's parser."""
    fixed = F.regexp_replace(F.regexp_replace("raw", "^new:~", ""), "'GET", '"GET')
    return judge_again(bad.withColumn("raw", F.when(F.startswith("raw", F.lit("new:~")), fixed).otherwise(F.col("raw"))))


def write_batch(spark, paths, number):
    rows = judged(spark, number)
    write_facts(enrich(good_rows(rows)), paths[1], "s", number)
    write_load(malformed_rows(rows), paths[0], "s", number)


@pytest.fixture
def tables(spark, tmp_path):
    paths = str(tmp_path / "bad"), str(tmp_path / "facts")
    for number in range(3):
        write_batch(spark, paths, number)
    return paths


def held(spark, paths):
    """(codes among facts, raws in the quarantine)"""
    codes = Counter(r.response_code for r in read_facts(spark, paths[1]).collect())
    return codes, Counter(r.raw for r in read_quarantine(spark, paths[0]).collect())


JUNK = Counter({"junk": 2, None: 1})
MOVED = Counter({200: 2, 201: 1, 202: 2, 203: 1})


def test_nothing_moves_without_a_change_of_the_parser(spark, tables, tmp_path):
    before = held(spark, tables)
    assert before[0] == {200: 2} and sum(before[1].values()) == 7
    assert replay(spark, *tables, stopped=True) == 0
    assert held(spark, tables) == before and Table(spark, tables[0]).latest().number == 3
    assert replay(spark, str(tmp_path / "none"), str(tmp_path / "no facts")) == 0


def test_the_last_batch_waits_and_a_second_replay_moves_nothing(spark, tables):
    assert replay(spark, *tables, judge=mended) == 3
    facts, bad = held(spark, tables)
    assert facts == {200: 2, 201: 1, 202: 2} and sum(bad.values()) == 4
    assert replay(spark, *tables, judge=mended) == 0 and held(spark, tables) == (facts, bad)
    for _ in range(2):
        replay(spark, *tables, judge=mended, stopped=True)
        assert held(spark, tables) == (MOVED, JUNK)
    reasons = Counter(r.reason for r in read_quarantine(spark, tables[0]).collect())
    assert reasons == {"no_match": 2, "null_payload": 1}
    assert read_facts(spark, tables[1]).where("response_code = 202").first().process_timestamp == "2024-01-05 10:01"


@pytest.mark.parametrize("number", range(3))
def test_a_batch_written_again_replaces_what_was_replayed(spark, tables, number):
    replay(spark, *tables, judge=mended, stopped=True)
    write_batch(spark, tables, number)
    codes, raws = held(spark, tables)
    back = Counter(int(line.split('" ')[1][:3]) for line in RECORDS[number] if line and line.startswith("new:"))
    assert codes == MOVED - back and sum(raws.values()) == 3 + sum(back.values())
    replay(spark, *tables, judge=mended, stopped=True)
    assert held(spark, tables) == (MOVED, JUNK)


class Lost(Exception):
    pass


@pytest.mark.parametrize("late", [False, True])
def test_a_replay_that_dies_at_any_step_is_made_good(spark, tmp_path, monkeypatch, late):
    publish, write_files = Store.publish, rp.write_files
    died = 0
    for step in range(40):
        paths = str(tmp_path / f"bad{step}"), str(tmp_path / f"facts{step}")
        for number in range(2):
            write_batch(spark, paths, number)
        left = [step]

        def dying(call):
            def run(*args, **kwargs):
                if left[0] == 0:
                    raise Lost
                left[0] -= 1
                return call(*args, **kwargs)

            return run

        monkeypatch.setattr(Store, "publish", dying(publish))
        monkeypatch.setattr(rp, "write_files", dying(write_files))
        try:
            replay(spark, *paths, judge=mended, stopped=not late)
            whole = True
        except Lost:
            whole, died = False, died + 1
        monkeypatch.setattr(Store, "publish", publish)
        monkeypatch.setattr(rp, "write_files", write_files)
        if late:
            write_batch(spark, paths, 2)
            # Batch 0 once more, also half way through a replay.
            write_batch(spark, paths, 0)
        replay(spark, *paths, judge=mended, stopped=True)
        codes, raws = held(spark, paths)
        assert (codes, raws) == (MOVED if late else MOVED - Counter({200: 1, 203: 1}), JUNK), step
        if whole:
            break
    assert whole and died >= 6


def test_replays_side_by_side_double_nothing(spark, tables):
    moved, errors = [], []

    def run():
        try:
            moved.append(replay(spark, *tables, judge=mended, stopped=True))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=run) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sum(moved) == 4 and held(spark, tables) == (MOVED, JUNK)


def test_replay_of_what_a_stream_has_set_aside(spark, topic, tmp_path):  # noqa: F811
    put, stream = topic
    paths = str(tmp_path / "bad"), str(tmp_path / "facts")
    put((0, payload()), (1, '{"a": 1}'), (2, '"open'))
    put((3, payload(404)), (4, None))

    def run():
        await_streams(fan_out(stream(), [fact_writer(paths[1])], [quarantine_writer(paths[0])], str(tmp_path / "cp"), DRAIN))

    run()

    def closes(bad):
        """A decoder that forgives a string that is not closed."""
        line = F.to_json(F.lit(VALID.replace(" 200 ", " 500 ")).cast("variant"))
        return judge_again(bad.withColumn("raw", F.when(F.col("raw") == '"open', line).otherwise(F.col("raw"))))

    assert replay(spark, *paths, judge=closes, stopped=True) == 1
    put((5, payload(301)), (6, '"open'))
    run()
    assert replay(spark, *paths, judge=closes, stopped=True) == 1
    codes, raws = held(spark, paths)
    assert codes == {200: 1, 404: 1, 500: 2, 301: 1} and raws == {'{"a": 1}': 1, None: 1}


def test_replay_from_the_command_line(spark, tmp_path, capsys):
    paths = str(tmp_path / "quarantine"), str(tmp_path / "facts")
    write_batch(spark, paths, 0)
    # A good line that an older parser has set aside.
    older = spark.createDataFrame([(datetime(2024, 1, 5), VALID, "no_match")], "process_timestamp timestamp, raw string, reason string")
    write_load(older, paths[0], "s", 1)
    main(["replay", str(tmp_path)])
    assert "0 records" in capsys.readouterr().out
    main(["replay", str(tmp_path), "--stopped"])
    assert "1 records" in capsys.readouterr().out and held(spark, paths)[0] == {200: 2}
