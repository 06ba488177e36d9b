import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from conftest import CHECKED
from logmill.llm import prefix_trie as pt
from odd import folder

TURNS = "conv_id long, turn long, role string, text string"
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def nodes(convs):
    """Nodes of ``{conv_id: [(role, text)]}`` from plain dictionaries."""
    members = {}
    for conv_id, turns in convs.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv_id)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    figures = {}
    for prefix in sorted(members, key=len, reverse=True):
        below = [figures[c] for c in children.get(prefix, [])]
        size = len(prefix[-1][1].encode()) if prefix else 0
        figures[prefix] = (
            sum(b[0] for b in below) if below else 1,
            sum(b[1] for b in below) + (len(members[prefix]) - 1) * size,
        )
    found = []
    for prefix, ids in members.items():
        ends = ",".join(str(i) for i in sorted(ids) if len(convs[i]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        found.append(
            (min(ids), len(prefix), parent, len(ids), len(children.get(prefix, [])), *figures[prefix],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(found, key=repr)


def rebuilt(rows):
    own = {}
    key = lambda r: hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, key(r))):
        if row[0] is not None:
            own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    found = {}
    for conv_id, turns in own.items():
        shared = zlib.crc32(str(conv_id).encode()) % 9
        base = conv_id - int(np.fmod(conv_id, 5))
        found[conv_id] = own.get(base, [])[:shared] + turns[shared:]
    return found


def query(spark, tmp_path, rows, clashing=False):
    turns = spark.createDataFrame(rows, TURNS)
    if clashing:
        turns = turns.selectExpr("*", *[f"1 AS {n}" for n in "path sizes part one key size base shared node ends of".split()])
    found = pt.op13_prefix_trie(spark, folder(tmp_path, conversations=turns))
    assert found.columns == NAMES
    return sorted(map(tuple, found.collect()), key=repr)


def made(count, seed, turns=6, texts=3):
    rng = random.Random(seed)
    rows = []
    for conv_id in range(count):
        for turn in range(rng.randrange(1, turns)):
            rows.append((conv_id, turn, rng.choice(["user", "bot"]), rng.choice(["é", "b", "cc", ""][: texts + 1])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("count,seed,texts", [(1, 1, 3), (12, 2, 1), (400, 3, 3), (300, 4, 1)])
def test_equals_brute_force(spark, tmp_path, count, seed, texts):
    rows = made(count, seed, texts=texts)
    assert query(spark, tmp_path, rows) == nodes(rebuilt(rows))


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "bot", "x"), (None, 1, "user", "x"),
        (2, 5, "", "long " * 60_000), (2, None, "userx", ""), (3, 1, "user", "x"), (-4, 1, "a", "bc"), (-7, 1, "ab", "c"),
        (5, 1, "u", "1"), (5, 2, "u", "2"), (6, 1, "u", "1"), (7, 1, "u", "9"), (2**40, 0, "a\x00", "\x00"),
    ]
    assert query(spark, tmp_path, rows, clashing=True) == nodes(rebuilt(rows))


def test_one_conversation_many_times(spark, tmp_path):
    rows = [(k, t, "u", f"turn {t}") for k in range(500) for t in range(3)] + [(k, 0, "u", "turn 0") for k in range(500, 530)]
    assert query(spark, tmp_path, rows) == nodes(rebuilt(rows))


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_any_number_of_blocks(spark, partitions):
    rows = made(150, 5, turns=9, texts=1)
    rows += [(1000 + k, 0, "user", "b") for k in range(90)]
    own = {}
    for row in sorted(rows, key=lambda r: r[1]):
        own.setdefault(row[0], []).append((row[2], row[3]))
    own[-1] = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        convs = pt.sequences(spark.createDataFrame(rows, TURNS))
        convs = convs.union(spark.sql("SELECT CAST(-1 AS BIGINT), X'', CAST(array() AS array<bigint>)"))
        found = pt.trie(convs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, found), key=repr) == nodes(own)


def test_a_long_conversation(spark, tmp_path):
    rows = [(0, t, "u", str(t % 7)) for t in range(3000)] + [(1, t, "u", str(t % 7)) for t in range(2000)]
    assert query(spark, tmp_path, rows) == nodes(rebuilt(rows))


def test_ends_of_runs_by_binary_search():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 7, 64, 100):
        lcps = rng.integers(0, 4, n)
        minima = pt.range_minima(lcps)
        at = np.repeat(np.arange(n), 5)
        depth = np.tile(np.arange(5), n)
        right, left = pt.right_end(minima, at, depth), pt.left_end(minima, at, depth)
        for i, d, r, lo in zip(at, depth, right, left):
            want_r = want_l = i
            while want_r + 1 < n and lcps[want_r + 1] >= d:
                want_r += 1
            while want_l > 0 and lcps[want_l] >= d:
                want_l -= 1
            assert (r, lo) == (want_r, want_l)


def test_query_matches_its_sql(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW conversations AS SELECT * FROM '{CHECKED}/conversations.parquet'")
    want = database.execute(pt.OP13_SQL).fetchall()
    found = pt.op13_prefix_trie(spark, CHECKED)
    assert found.columns == [c[0] for c in database.description]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
