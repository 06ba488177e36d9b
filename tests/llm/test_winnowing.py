import hashlib
import random
import re

import duckdb
import pytest

from conftest import CHECKED
from logmill.llm import winnowing as wn
from odd import LONG, documents, folder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def judged(doc_id, text, items):
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        seq = words(item)
        size = min(len(seq), 13)
        windows = {tuple(seq[i : i + size]) for i in range(len(seq) - size + 1)} if seq else set()
        for i in range(len(own) - size + 1):
            if seq and tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return doc_id, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)


def check(spark, tmp_path, rows, items, clashing=False):
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows], clashing)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = wn.op4_decontamination(spark, folder(tmp_path, documents=docs, benchmark=tests))
    want = sorted(str(judged(i, t, items)) for i, t in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    return want


def spliced(seed):
    """Few words, so that windows, ties and repeats abound."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("a b c d".split()) for _ in range(n))
    items = [(i, text(draw.choice([1, 2, 5, 12, 13, 14, 20, 30]))) for i in range(8)]
    rows = []
    for i in range(25):
        item = draw.choice(items)[1].split()
        cut = draw.randrange(len(item) + 1)
        rows.append((i, f"{text(draw.randint(0, 20))} {' '.join(item[cut:])} {text(draw.randint(0, 9))}"))
    return rows, items


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, broadcast):
    monkeypatch.setattr(wn, "BROADCAST_FINGERPRINTS", broadcast)
    rows, items = spliced(seed)
    check(spark, tmp_path, rows, items)


def test_every_shared_span_of_a_window_is_found(spark, tmp_path):
    item = " ".join(f"i{k}" for k in range(40))
    rows = []
    for start in range(28):
        for length in (12, 13, 14):
            span = item.split()[start : start + length]
            rows.append((len(rows), " ".join(["x"] * (start % 5) + span + ["y"] * 300)))
    want = check(spark, tmp_path, rows, [(1, item)])
    assert any("False" in row for row in want)


def test_odd_rows(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, passage.upper()),
        (2, None),
        (3, ""),
        (4, "... 123 !!!"),
        (5, LONG + passage),
        (6, passage.replace(" ", ", ")),
        (6, passage.replace(" ", ", ")),
        (None, f"É {passage}"),
        (7, f"é {passage}"),
        (8, " ".join([passage] * 30)),
    ]
    items = [(1, passage), (2, None), (3, ""), (10, passage), (11, "É one"), (12, "short item"), (13, "?")]
    check(spark, tmp_path, rows, items, clashing=True)


def test_empty_tables(spark, tmp_path):
    check(spark, tmp_path / "a", [], [(1, "a b c")])
    check(spark, tmp_path / "b", [(1, "a b c")], [])


def test_rows_and_spans_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "z a b c z", 5)], "doc_id long, text string, n_hit long")
    items = spark.createDataFrame([(4, "a b c")], "item_id long, text string")
    row = wn.contamination(docs, items, docs.columns).first()
    assert [tuple(s) for s in row["spans"]] == [(1, 3)] and row["items"] == ["4"]
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (5, 3, True)


def test_query_matches_its_sql(spark):
    database = duckdb.connect()
    for table in ("documents", "benchmark"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{CHECKED}/{table}.parquet'")
    want = database.execute(wn.OP4_SQL).fetchall()
    got = wn.op4_decontamination(spark, CHECKED).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r[-1] for r in want)


def test_plan_is_native(spark):
    plan = wn.op4_decontamination(spark, CHECKED)._jdf.queryExecution().executedPlan().toString()
    for foreign in ("Python", "InPandas", "InArrow", "Cartesian", "NestedLoop"):
        assert foreign not in plan
