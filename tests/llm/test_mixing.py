import hashlib
import random
import re
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from conftest import CHECKED
from logmill.llm import mixing
from odd import DOCUMENTS, documents, folder

NAMES = "doc_id size source_size target taken".split()


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(totals, total=None, repeats=3):
    """Targets in exact fractions, by the rounds of the contract."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    held, left = {}, Fraction(sum(totals.values()) if total is None else total)
    while rest := [s for s in names if s not in held]:
        even = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if even[s] > repeats * totals[s]]
        if not above:
            return {s: float(held.get(s, even.get(s))) for s in names}
        for s in above:
            held[s] = Fraction(repeats * totals[s])
            left -= held[s]
    return {s: float(held[s]) for s in names}


def expected(rows):
    totals = {}
    for row in rows:
        totals[row[3]] = totals.get(row[3], 0) + words(row[1])
    aims, found = shares(totals), []
    for source, aim in aims.items():
        mine = [r for r in rows if r[3] == source]
        mine.sort(key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15])
        times = int(aim // totals[source]) if totals[source] else 0
        left = aim - times * totals[source]
        for row in mine:
            size = words(row[1])
            more = left > 0 and 2 * left >= size
            left -= size
            found.append((row[0], size, totals[source], round(aim, 6), size * (times + more)))
    return sorted(found, key=repr)


def query(spark, tmp_path, docs):
    found = mixing.op12_mixing(spark, folder(tmp_path, documents=docs))
    assert found.columns == NAMES
    rows = [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in found.collect()]
    return sorted(rows, key=repr)


def test_odd_rows(spark, tmp_path):
    docs = documents(spark, clashing=True)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert query(spark, tmp_path, docs) == expected(rows)


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    sources = [None, "", *"abcdefghij", "😀", "ä"]
    rows = []
    for k in range(1500):
        source = "hot" if k % 3 == 0 else sources[int(rng.random() ** 3 * len(sources))]
        rows.append((k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(30))), None, source, 0))
    found = query(spark, tmp_path, spark.createDataFrame(rows, DOCUMENTS))
    assert found == expected(rows)
    by_id = {r[0]: r for r in rows}
    near = {}
    for doc_id, size, total, target, taken in found:
        assert taken <= 3 * size
        got = near.setdefault(by_id[doc_id][3], [0, target, 0])
        got[0] += taken
        got[2] = max(got[2], size)
    assert all(abs(got - target) <= longest / 2 for got, target, longest in near.values())


def test_repeated_rows_are_told_apart_only_in_number(spark, tmp_path):
    rows = [(7, "a b c", None, "x", 0)] * 400 + [(k, "d e", None, "y", 0) for k in range(900)]
    found = query(spark, tmp_path, spark.createDataFrame(rows, DOCUMENTS))
    assert found == expected(rows)
    assert len({r[4] for r in found if r[0] == 7 and r[1] == 3}) <= 2


def test_no_words_and_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert query(spark, tmp_path, empty) == []
    docs = spark.createDataFrame([(1, None, None, "a", 0), (2, " ", None, None, 0)], DOCUMENTS)
    found = mixing.mix(docs).select("row.doc_id", "target", "copies").collect()
    assert sorted(map(tuple, found)) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_smaller_budgets_are_nested_in_larger_ones(spark):
    docs = spark.createDataFrame([(k, "a b c d", None, f"s{k % 4}", 0) for k in range(600)], DOCUMENTS)
    taken = {}
    for total in (0, 300, 900, 2400, 5000, 7200, 10**9):
        mixed = mixing.mix(docs, keep=["doc_id"], total=total).select("row.doc_id", "copies").collect()
        taken[total] = dict(map(tuple, mixed))
    steps = list(taken.values())
    for less, more in zip(steps, steps[1:]):
        assert all(less[k] <= more[k] for k in less)
    assert set(steps[0].values()) == {0} and set(steps[-1].values()) == {3}


def test_a_source_that_is_too_small_for_its_share(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 100, 2), ("c", 1000, 3), ("d", 0, 1)], "source string, words long, weight long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0, "d": 0.0} and sum(got.values()) == 1110


def test_words_are_counted_in_whole_long_texts(spark):
    text = "x\x0b\x1fy z \t" * 300_000
    assert spark.range(1).select(mixing.word_count(F.lit(text))).first()[0] == words(text)


def test_query_matches_its_sql(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{CHECKED}/documents.parquet'")
    want = database.execute(mixing.OP12_SQL).fetchall()
    found = mixing.op12_mixing(spark, CHECKED)
    assert found.columns == [c[0] for c in database.description]
    assert sorted(map(tuple, found.collect())) == sorted(want)
