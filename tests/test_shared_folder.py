"""Queries that store tables, in a session whose master is not a local one."""

import os

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as registry
from logmill.llm.common import stored
from logmill.sources import shared

from conftest import SMALL

MASTER = "spark://host:7077"
STORING = [n for n in registry.queries() if n.startswith(("days_", "partition_", "stream_", "pipeline"))] + [
    n for n in registry.queries() if n.startswith("op") and n.split("_")[0] not in ("op1", "op4", "op7")
]


@pytest.fixture
def cluster(spark, monkeypatch):
    """Give the session a cluster's master and ``spark.checkpoint.dir``."""

    def use(folder):
        get = type(spark.conf).get
        monkeypatch.setattr(spark.sparkContext, "master", MASTER)
        monkeypatch.setattr(
            type(spark.conf),
            "get",
            lambda self, key, *other: folder if key == "spark.checkpoint.dir" else get(self, key, *other),
        )
        for kept in ("_tried", "_found"):
            monkeypatch.setattr(shared, kept, {}, raising=False)

    return use


@pytest.mark.parametrize("scheme", ["file://", "file:", ""])
def test_a_path_that_executors_share_is_taken(spark, cluster, tmp_path, scheme):
    cluster(f"{scheme}{tmp_path}")
    rows = stored(spark.range(0, 100, 1, 10), "t")
    assert sorted(r.id for r in rows.collect()) == list(range(100))
    assert rows._stored_at.startswith("file:") and str(tmp_path) in rows._stored_at
    assert not [name for name in os.listdir(tmp_path) if "trial" in name]


def test_a_path_is_tried_once(spark, cluster, tmp_path, monkeypatch):
    cluster(f"file://{tmp_path}")
    shared.shared_folder(spark, "t")
    monkeypatch.setattr(DataFrameWriter, "parquet", None)
    shared.shared_folder(spark, "t")
    monkeypatch.setattr(shared, "_tried", dict.fromkeys(shared._tried, {"gone:1"}))  # another executor has come
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(spark, "t")


@pytest.fixture
def unshared(monkeypatch):
    """Let one file that is written below a folder stay on another machine."""
    write, lost = DataFrameWriter.parquet, []

    def elsewhere(self, path):
        write(self, path)
        folder = path.removeprefix("file:").replace("//", "/")
        if any(folder.startswith(one) for one in lost):
            os.remove(f"{folder}/{min(name for name in os.listdir(folder) if name.startswith('part-'))}")

    monkeypatch.setattr(DataFrameWriter, "parquet", elsewhere)
    return lost


def test_places_where_files_of_executors_are_missing_are_refused(spark, cluster, tmp_path, monkeypatch, unshared):
    unshared.append("/")
    cluster(f"file://{tmp_path}")
    with pytest.raises(ValueError, match="path of one machine") as raised:
        shared.shared_folder(spark, "t")
    assert "are missing" in str(raised.value.__cause__)
    cluster(None)
    monkeypatch.setattr(shared.tempfile, "gettempdir", lambda: str(tmp_path))
    with pytest.raises(ValueError, match="set spark.checkpoint.dir"):
        shared.shared_folder(spark, "t")
    assert not os.listdir(tmp_path)


def test_the_first_place_that_executors_share_serves(spark, cluster, tmp_path, monkeypatch, unshared):
    monkeypatch.setattr(shared, "_PLACES", [p for p in shared._PLACES if "spark.sql.warehouse.dir" not in p.__code__.co_consts])
    monkeypatch.setattr(shared.tempfile, "gettempdir", lambda: f"{tmp_path}/last")
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: f"file:{tmp_path}/second")
    cluster(f"{tmp_path}/first")
    unshared.append(f"{tmp_path}/first")
    with pytest.warns(UserWarning, match="do not share"):
        assert shared.shared_folder(spark, "t").startswith(f"file:{tmp_path}/second/logmill-")
    cluster(None)
    unshared.append(f"{tmp_path}/second")
    assert shared.shared_folder(spark, "t").startswith(f"file:{tmp_path}/last/logmill-")
    assert shared.shared_folder(spark, "t").startswith(f"file:{tmp_path}/last/logmill-")


@pytest.mark.parametrize("name", STORING)
def test_query_runs_on_a_cluster(spark, cluster, tmp_path, name):
    cluster(f"file://{tmp_path}")
    assert registry.queries()[name](spark, SMALL).count() > 0
    assert os.listdir(tmp_path)
