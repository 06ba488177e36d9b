import numpy as np
import pytest
import xxhash

from conftest import CHECKED
from logmill.llm import simhash as sh
from logmill.llm.graph import components
from odd import TEXTS, documents, folder


def plain_fingerprint(text):
    words = [w for w in bytes(text or "", "utf-8").lower().split()]
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i:] ^ values[i]) <= radius):
            parent[top(i + int(j))] = top(i)
    least = {}
    for i, name in enumerate(ids):
        known = [n for n in (least.get(top(i)), name) if n is not None]
        least[top(i)] = min(known) if known else None
    return [least[top(i)] for i in range(len(ids))]


def expected(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    roots = plain_components([i for i, _ in rows], prints)
    return sorted(str((i, f"{p:016x}", c)) for (i, _), p, c in zip(rows, prints, roots, strict=True))


def test_query_on_odd_rows(spark, tmp_path):
    got = sh.op9_simhash(spark, folder(tmp_path, documents=documents(spark, clashing=True)))
    assert sorted(str(tuple(r)) for r in got.collect()) == expected([r[:2] for r in TEXTS])


def test_query_on_all_documents(spark):
    rows = spark.read.parquet(f"{CHECKED}/documents.parquet").select("doc_id", "text").collect()
    got = sh.op9_simhash(spark, CHECKED)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected([tuple(r) for r in rows])


def test_empty_table(spark, tmp_path):
    assert sh.op9_simhash(spark, folder(tmp_path, documents=documents(spark, []))).collect() == []


def test_long_texts_in_slices(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    whole = sh.fingerprint(text)
    monkeypatch.setattr(sh, "_SLICE", 11)
    assert sh.fingerprint(text) == whole == plain_fingerprint(text)


def crowded(seed=1, size=1500):
    """Fingerprints around three centres: long lists, chains and near misses."""
    draw = np.random.default_rng(seed)
    centres, found = draw.integers(0, 2**63, 3), {0}
    for _ in range(size):
        value = int(centres[draw.integers(3)])
        for bit in draw.integers(0, 64, draw.integers(0, 9)):
            value ^= 1 << int(bit)
        found.add(value)
    return np.array(sorted(found), np.uint64)


@pytest.mark.parametrize("block", [2048, 40])
@pytest.mark.parametrize("radius", [1, 3])
def test_links_of_crowded_fingerprints(spark, monkeypatch, block, radius):
    monkeypatch.setattr(sh, "BLOCK", block)
    values = crowded()
    names = values.view(np.int64).tolist()
    prints = spark.createDataFrame([(n,) for n in names], "print bigint")
    roots = {r["node"]: r["root"] for r in components(sh.links(prints, radius)).collect()}
    assert [roots.get(n, n) for n in names] == plain_components(names, values.tolist(), radius)


def test_no_task_reports_all_pairs_of_a_group(spark):
    values = np.array([(1 << 40) + (1 << b) for b in range(40)], np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in values], "print bigint")
    found = sh._search(sh._index(prints, 3), 3, sh.BLOCK).count()
    assert found < 35 * len(values)


def test_radius_must_leave_a_shared_byte(spark):
    with pytest.raises(ValueError, match="radius"):
        sh._index(spark.createDataFrame([(1,)], "print bigint"), 7)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1200)]
    odd = [(5, 5), (None, 3), (9, None), (21, 20), (20, 21), (20, 21)]
    edges = spark.createDataFrame(chain + star + odd, "u long, v long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = dict.fromkeys(range(100, 161), 100) | dict.fromkeys([7, *range(1000, 1200)], 7) | {20: 20, 21: 20}
    assert roots == want
    assert components(edges.limit(0)).collect() == []
