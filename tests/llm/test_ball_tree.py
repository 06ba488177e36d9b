import duckdb
import numpy as np
import pytest

from conftest import CHECKED
from logmill.llm import ball_tree as bt
from odd import folder

VECTORS = "vec_id long, embedding array<float>, label int"


def expected(rows, top=bt.TOP, every=bt.QUERY_EVERY):
    usable = [
        (i, [int(np.floor(64 * float(np.float32(x)))) for x in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = []
    for query, q in dict(usable).items():
        if query % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != query]
            for rank, (score, i) in enumerate(sorted(scored)[:top], 1):
                found.append((query, rank, i, -score))
    return sorted(found)


def vectors(size, width=8, seed=3, kinds=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(kinds, width))
    rows = centres[draw.integers(kinds, size=size)] + 0.2 * draw.normal(size=(size, width))
    return [(i, [float(x) for x in row], 0) for i, row in enumerate(rows)]


def query(spark, tmp_path, rows, clashing=False):
    table = spark.createDataFrame(rows, VECTORS)
    if clashing:
        table = table.selectExpr("*", *[f"1 AS {n}" for n in "parts path kth score rank query_id number shards".split()])
    return sorted(map(tuple, bt.op6_ball_tree(spark, folder(tmp_path, embeddings=table)).collect()))


def test_query_matches_its_sql(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{CHECKED}/embeddings.parquet'")
    want = sorted(database.execute(bt.OP6_SQL).fetchall())
    assert sorted(map(tuple, bt.op6_ball_tree(spark, CHECKED).collect())) == want and want


def test_many_small_shards_blocks_and_groups(spark, tmp_path, monkeypatch):
    for name, size in (("SHARD", 50), ("LEAF", 4), ("BLOCK", 7), ("GROUP", 3)):
        monkeypatch.setattr(bt, name, size)
    rows = vectors(700)
    assert query(spark, tmp_path, rows) == expected(rows)


def test_pairs_of_blocks_and_groups_share_few_tasks(spark, tmp_path, monkeypatch):
    for name, size in (("SHARD", 20), ("LEAF", 4), ("BLOCK", 3), ("GROUP", 2), ("TASKS", 5)):
        monkeypatch.setattr(bt, name, size)
    rows = vectors(600)
    table = bt.quantized(spark.createDataFrame(rows, VECTORS))
    index = bt.write_index(table, str(tmp_path / "trees"))
    monkeypatch.setattr(type(index), "collect", lambda df: pytest.fail("collected"))
    found = bt.search(table.filter(f"vec_id % {bt.QUERY_EVERY} = 0"), index, str(tmp_path / "trees"))
    monkeypatch.undo()
    assert "Repartition" in (plan := found._jdf.queryExecution().optimizedPlan().toString())
    assert "RepartitionByExpression [path" in plan and "], 5" in plan
    assert index.count() > 20 and sorted(map(tuple, found.collect())) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [
        *vectors(50, 3),
        *[(100 + i, [0.5, 0.5, 0.5], 0) for i in range(30)],  # equal scores
        (200, None, 1),
        (220, [0.1, None, 0.2], 1),
        (240, [float("nan"), 0.0, 0.0], 1),
        (260, [float("inf"), 0.0, 0.0], 1),
        (None, [1.0, 1.0, 1.0], 1),
        (280, [], 1),
        (300, [1.0], 1),
        (320, [1.0, 2.0, 3.0, 4.0, 5.0], 1),
        (340, [0.0, 0.0, 0.0], 1),
        (-20, [-1.0, 1.0, -1.0], 1),
        (360, [-0.001, 0.999, 1.0], 1),
    ]
    assert query(spark, tmp_path, rows, clashing=True) == expected(rows)


def test_repeated_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (5, [0.5, 0.5], 0), (5, [0.5, 0.5], 0), (7, [0.1, 0.0], 0)]
    assert [r[2] for r in query(spark, tmp_path, rows)] == [5, 5, 7]


@pytest.mark.parametrize("turn", [1, -1])
def test_of_queries_with_one_id_the_smallest_is_answered(spark, tmp_path, turn):
    rows = [(20, [3.0, -1.0], 0), (20, [-2.0, 1.0], 0), (20, [1.0, 1.0], 0)]
    others = [(i, [float(i % 5 - 2), float(i % 3 - 1)], 0) for i in range(1, 20)]
    # ``expected`` answers the last row of an id.
    last = [(20, [3.0, -1.0], 0), (20, [1.0, 1.0], 0), (20, [-2.0, 1.0], 0)]
    assert query(spark, tmp_path, rows[::turn] + others) == expected(others + last)


def test_fewer_vectors_than_answers_and_none(spark, tmp_path):
    assert query(spark, tmp_path / "a", [(0, [1.0], 0), (1, [2.0], 0)]) == [(0, 1, 1, 64 * 128)]
    assert query(spark, tmp_path / "b", [(0, [1.0], 0)]) == []
    assert query(spark, tmp_path / "c", []) == []


def test_large_components_are_exact(spark, tmp_path):
    rows = [(0, [2.0**24, 3.0], 0), (1, [2.0**22, 1.0], 0), (2, [2.0**22, 1.03125], 0), (3, [-(2.0**21), 0.0], 0)]
    assert query(spark, tmp_path, rows) == expected(rows)
    rows = [(0, [1e30], 0), (1, [1e30], 0), (2, [-1e30], 0)]
    assert [r[2:] for r in query(spark, tmp_path / "x", rows)] == [(1, 2**63 - 1), (2, -(2**63) + 1)]


def test_bounds_leave_parts_of_the_tree_out(monkeypatch):
    rows = vectors(4000, 4)
    ids = np.array([i for i, *_ in rows])
    matrix = np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64)
    tree = bt.build_tree(ids, matrix)
    block = bt.Block.of({"ids": ids[:3], "vectors": matrix[:3]}, 5, None)
    scored = []
    products = bt._products
    monkeypatch.setattr(bt, "_products", lambda q, v: scored.append(q.shape[0] * v.shape[0]) or products(q, v))
    bt.search_tree(block, tree)
    assert sum(scored) < 3 * 4000 / 2
    want = [sorted((-int(matrix[q] @ matrix[i]), i) for i in range(4000) if i != q)[:5] for q in range(3)]
    assert [[(-s, i) for s, i in zip(*pair)] for pair in zip(block.scores.tolist(), block.found.tolist())] == want


def test_shared_scores_leave_lower_answers_out():
    tree = bt.build_tree(np.arange(10), np.arange(10)[:, None])
    block = bt.Block.of({"ids": np.array([99]), "vectors": np.array([[1]])}, 3, np.array([8]))
    bt.search_tree(block, tree)
    assert block.scores[0, :2].tolist() == [9, 8]


@pytest.mark.parametrize("size", [1, 64, 65, 1000])
def test_balls_hold_their_vectors(size):
    draw = np.random.default_rng(size)
    tree = bt.build_tree(np.arange(size), draw.integers(-50, 50, (size, 5)))
    for start, end, centre, radius in zip(tree["start"], tree["end"], tree["centre"], tree["radius"]):
        assert (np.linalg.norm(tree["vectors"][start:end] - centre, axis=1) <= radius + 1e-9).all()
    leaves = tree["left"] < 0
    assert (tree["end"] - tree["start"])[leaves].sum() == size
