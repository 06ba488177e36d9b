import json
from collections import Counter

import pytest

from logmill import __main__ as command
from logmill.sources.lines import decode_records, records, stream_text_lines
from logmill.sources.tables import read_facts, write_facts
from logmill.streaming.pipelines import DRAIN

from conftest import VALID
from test_compact import batch
from test_serving import DAY
from test_streaming import payload, topic  # noqa: F401


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(command, "build_session", lambda: spark)
    return command.main


def test_lines_of_a_folder_are_sent_once(spark, tmp_path, run):
    (tmp_path / "in").mkdir()
    sink = ["--connector", "parquet", "--sink-option", f"path={tmp_path}/out"]
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.log").write_text(f"{name} 1\n{name} 2\n")
        for _ in range(2):  # again, as after a restart
            run(["publish", f"{tmp_path}/in", "--brokers", "b:1", "--topic", "t", "--follow", f"{tmp_path}/cp", "--once", *sink])
    sent = spark.read.parquet(f"{tmp_path}/out").selectExpr("timestamp_millis(0) AS timestamp", "value")
    assert Counter(r.value for r in decode_records(records(sent)).collect()) == Counter(
        f"{name} {k}\n" for name in "ab" for k in (1, 2)
    )


def test_new_files_of_a_folder_are_parsed_once(spark, tmp_path):
    from logmill.operators.parse import DROPMALFORMED, parse_lines

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.log").write_text(f"{VALID}\njunk\n")
        for _ in range(2):
            parsed = parse_lines(stream_text_lines(spark, f"{tmp_path}/in", 1), mode=DROPMALFORMED)
            out = parsed.writeStream.format("parquet").option("path", f"{tmp_path}/out")
            out.option("checkpointLocation", f"{tmp_path}/cp").trigger(**DRAIN).start().awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == k + 1


def test_a_stream_into_a_connector(spark, topic, tmp_path, run, monkeypatch):  # noqa: F811
    put, stream = topic
    put((0, payload()), (0, payload()), (1, "{bad"))
    monkeypatch.setattr(command, "_topic", lambda spark, args: stream())
    monkeypatch.setattr(command, "_trigger", lambda args: DRAIN)
    out = f"{tmp_path}/out"
    for _ in range(2):
        run(["stream", "--brokers", "b", "--topic", "t", "--out", out, "--sink", "json", "--sink-option", f"path={tmp_path}/json"])
    rows = spark.read.json(f"{tmp_path}/json")
    assert rows.count() == 2 == rows.select("row_key").distinct().count()
    accounts = list((tmp_path / "out" / "accounts").rglob("*.json"))
    assert [json.loads(a.read_text())["bad"] for a in accounts] == [1]


def test_history_hour_and_vacuum(spark, tmp_path, run, capsys):
    path = str(tmp_path / "facts")
    for number in range(3):
        write_facts(batch(spark, number), path, "s", number)
    run(["compact", path, "--day", str(DAY)])
    run(["history", path])
    lines = capsys.readouterr().out.splitlines()
    assert [line.split("\t")[2] for line in lines] == ["write"] * 3 + ["compact"]
    run(["day", path, "--day", str(DAY), "--hour", "10"])
    assert "10:00" in capsys.readouterr().out
    run(["day", path, "--day", str(DAY), "--hour", "3"])
    assert "No data" in capsys.readouterr().out
    run(["vacuum", path])
    assert read_facts(spark, path).count() == 9
