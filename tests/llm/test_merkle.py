import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import CHECKED
from logmill.llm import merkle
from odd import DOCUMENTS, documents, folder

NAMES = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, at, start=None):
    """(root, siblings on the way up, root from ``start``) of plain lists."""
    proof, own = [], start or nodes[at]
    while len(nodes) > 1:
        low = at // 16 * 16
        run = nodes[low : low + 16]
        proof += run[: at - low] + run[at - low + 1 :]
        own = sha(*run[: at - low], own, *run[at - low + 1 :])
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], proof, own


def expected(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    key = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    groups = [sorted((r for r in rows if r[3] == s), key=key) for s in sources]
    subroots = [climb([leaf(r) for r in group], 0)[0] for group in groups]
    found = []
    for g, group in enumerate(groups):
        leaves = [leaf(r) for r in group]
        for at, row in enumerate(group):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1] or "")
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            own = leaf((row[0], None if row[1] is None else lower, *row[2:])) if hit else leaves[at]
            subroot, low, half = climb(leaves, at, own)
            root, high, _ = climb(subroots, g)
            folded = climb(subroots, g, half)[2]
            found.append((row[0], leaves[at], subroot, root, sha(*low, *high), folded, folded == root))
    return sorted(found, key=repr)


def query(spark, tmp_path, docs):
    found = merkle.op11_merkle(spark, folder(tmp_path, documents=docs))
    assert found.columns == NAMES
    return sorted(map(tuple, found.collect()), key=repr)


def made(count, seed=1):
    rng = random.Random(seed)
    sources = [None, "", "hot", "hot", "hot", "b", "ä", "😀", "one"]
    return [
        (k, rng.choice(["Abc", "abc", None, "", "É" * k]), rng.choice(["en", None]), sources[rng.randrange(8)] if k else "one", k % 7)
        for k in range(count)
    ]


def test_odd_rows(spark, tmp_path):
    docs = documents(spark, clashing=True)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert query(spark, tmp_path, docs) == expected(rows)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 700])
def test_equals_plain_lists(spark, tmp_path, count):
    rows = made(count)
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert query(spark, tmp_path, docs) == expected(rows)


def test_hot_source_repeated_rows_and_many_sources(spark, tmp_path):
    rows = [(5, "Same", "en", "hot", 4)] * 300 + [(k, "T", None, f"s{k}", 1) for k in range(300)]
    found = query(spark, tmp_path, spark.createDataFrame(rows, DOCUMENTS))
    assert found == expected(rows)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert query(spark, tmp_path, empty) == []
    assert merkle.manifest(empty).root() is None


def test_manifest_of_other_columns_and_fanout(spark):
    docs = spark.createDataFrame([("x", 1, "a"), ("y", 2, "b"), ("z", 3, "c")], "g string, k long, v string")
    whole = merkle.manifest(docs, ["k", "v"], "k", "g", fanout=2)
    leaves = [sha(f"1:{k}", f"1:{v}") for k, v in [(1, "a"), (2, "b"), (3, "c")]]
    assert whole.root() == sha(sha(*leaves[:2]), sha(leaves[2]))
    folded = whole.proofs().select(merkle.fold(F.col("item.digest"), F.col("path")).alias("r")).collect()
    assert {r["r"] for r in folded} == {whole.root()}
    with pytest.raises(ValueError):
        merkle.manifest(docs, ["k"], "k", "g", fanout=1)


def test_query_matches_its_sql(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{CHECKED}/documents.parquet'")
    want = database.execute(merkle.OP11_SQL).fetchall()
    found = merkle.op11_merkle(spark, CHECKED)
    assert found.columns == [c[0] for c in database.description]
    assert sorted(map(tuple, found.collect())) == sorted(want)
