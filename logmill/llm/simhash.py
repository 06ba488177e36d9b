"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint of 64 bits is 8 bytes at 8 positions. Two fingerprints that differ in at
most ``RADIUS`` bits differ in at most as many bytes, so they share at least
``8 - RADIUS`` bytes in place: the count a pair must reach. Lists of single bytes would
each hold a 256th of all fingerprints; instead the index counts ahead: of the first
``POSITIONS`` bytes a pair shares at least ``8 - RADIUS - (8 - POSITIONS)``, so each
fingerprint is listed once for every choice of that many of those positions, under the
bytes there. Pairs of a list are counted over all 8 positions, pairs below the guaranteed
count go, the rest is verified bit by bit.

Only distinct fingerprints are indexed, and a task reports a spanning forest of the links
it finds, never all pairs of a group. Lists longer than a block are dealt out as pairs of
blocks to separate tasks, so every pair is still compared and no task holds a whole list.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import map_batches, read_table, stored
from logmill.llm.graph import components

SHINGLE, RADIUS = 3, 3
BYTES, POSITIONS = 8, 7
# Fingerprints of a list that are compared within one task.
BLOCK = 2048
# Shingles hashed at once, whatever the length of a text.
_SLICE = 1 << 16
_POSTING = "list bigint, low int, high int, print bigint"


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; A-Z lower-cased, words split at ASCII white space."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    count = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, count, _SLICE):
        part = words[start : start + _SLICE + size - 1]
        runs = zip(*(part[k:] for k in range(size)), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(run), 42) for run in runs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``print`` (the fingerprint's bits as a signed integer) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = np.array([fingerprint(text or "", shingle) for text in texts], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"]
        )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, print bigint")


def _index(prints: DataFrame, radius: int) -> DataFrame:
    """One row per fingerprint and list."""
    shared = BYTES - radius - (BYTES - POSITIONS)
    if shared < 1:
        raise ValueError(f"a radius of {radius} leaves no byte that a pair must share")
    value = F.col("print")
    byte = [F.shiftrightunsigned(value, 8 * p).bitwiseAND(F.lit(0xFF)) for p in range(POSITIONS)]
    lists = []
    for number, chosen in enumerate(combinations(range(POSITIONS), shared)):
        key = F.lit(number).cast("bigint")
        for position in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(byte[position])
        lists.append(key)
    return prints.select(
        F.explode(F.array(*lists)).alias("list"),
        F.lit(0).alias("low"),
        F.lit(0).alias("high"),
        "print",
    )


def _linked(prints: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs reach the count of shared bytes and then the radius."""
    differ = prints[first] ^ prints[second]
    tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    linked = tally >= BYTES - radius
    linked[linked] = np.bitwise_count(differ[linked]) <= radius
    return linked


def _forest(ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (from the smallest member) that join exactly what the given links join."""
    nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
    u, v = places[: len(places) // 2], places[len(places) // 2 :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _compare(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group`` numbers."""
    first, step, firsts, seconds = np.arange(len(prints)), 1, [], []
    while len(first):
        first = first[first + step < len(prints)]
        first = first[group[first] == group[first + step]]
        hit = first[_linked(prints, first, first + step, radius)]
        if len(hit):
            firsts.append(prints[hit])
            seconds.append(prints[hit + step])
        step += 1
    if not firsts:
        return prints[:0], prints[:0]
    return _forest(firsts + seconds)


def _search(postings: DataFrame, radius: int, limit: int) -> DataFrame:
    """Links within each group of postings (``low`` = -1), and, for groups of more than
    ``limit`` members, their members with their block (``low``)."""

    def rows(u: np.ndarray, v: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(u.astype(np.int64)), pa.array(v.view(np.int64)), pa.array(low.astype(np.int32))], ["u", "v", "low"]
        )

    def members(key: int, prints: np.ndarray, start: int) -> pa.RecordBatch:
        return rows(np.full(len(prints), key), prints, (start + np.arange(len(prints))) // BLOCK)

    def found(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Results of whole groups of at most ``limit`` members."""
        change = np.ones(len(prints), bool)
        change[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        u, v = _compare(np.cumsum(change), prints, radius)
        if len(u):
            yield rows(u.view(np.int64), v, np.full(len(u), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty((3, 0), np.int64), np.empty(0, np.uint64)
        long_key, passed = None, 0  # the long list that is being dealt out, and how far
        for batch in batches:
            new = [batch.column(n).to_numpy().astype(np.int64) for n in ("list", "low", "high")]
            keys = np.concatenate([keys, new], axis=1)
            prints = np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
            if long_key is not None:
                other = np.flatnonzero((keys != long_key[:, None]).any(axis=0))
                end = other[0] if len(other) else len(prints)
                if end:
                    yield members(int(long_key[0]), prints[:end], passed)
                    passed += int(end)
                if not len(other):
                    keys, prints = keys[:, :0], prints[:0]
                    continue
                keys, prints, long_key = keys[:, end:], prints[end:], None
            if not len(prints):
                continue
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            sizes = np.diff(np.append(starts, len(prints)))
            last = starts[-1]  # this group may go on in the next batch
            for place in np.flatnonzero(sizes[:-1] > limit):
                start, size = starts[place], sizes[place]
                yield members(int(keys[0, start]), prints[start : start + size], 0)
            short = np.repeat(sizes <= limit, sizes)
            short[last:] = False
            yield from found(keys[:, short], prints[short])
            if sizes[-1] > limit:
                long_key, passed = keys[:, last].copy(), int(sizes[-1])
                yield members(int(long_key[0]), prints[last:], 0)
                last = len(prints)
            keys, prints = keys[:, last:].copy(), prints[last:].copy()
        yield from found(keys, prints)

    spread = postings.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "print")
    return spread.mapInArrow(run, "u bigint, v bigint, low int")


def _block_pairs(members: DataFrame) -> DataFrame:
    """The members of long lists once for each pair of blocks that holds their own."""
    blocks = members.groupBy(F.col("u").alias("key")).agg(F.max("low").alias("last"))
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    return (
        members.join(blocks, F.col("u") == F.col("key"))
        .select("u", "v", F.col("low").alias("own"), other)
        .select(
            F.col("u").alias("list"),
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            F.col("v").alias("print"),
        )
    )


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u``, ``v``: links that connect exactly the distinct ``print`` values which chains
    of pairs within ``radius`` bits connect."""
    found = stored(_search(_index(prints, radius), radius, BLOCK), "simhash-links")
    near = found.filter("low < 0").select("u", "v")
    members = found.filter("low >= 0")
    if not members.isEmpty():
        pairs = _search(_block_pairs(members), radius, 2 * BLOCK)
        near = near.union(pairs.select("u", "v"))
    return near.distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``doc_id``, ``print``, ``component_id`` of every row.

    The component is the smallest id that links reach, the row's own included. NULL and
    empty texts have fingerprint zero, which is linked like any other. Rows with NULL ids
    take part; a component of such rows alone has a NULL id. Repeated rows stay. An empty
    table gives an empty result.
    """
    prints = stored(fingerprints(docs, doc_id, text, shingle), "simhash-prints")
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("print"), radius))
    rooted = distinct.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    named = rooted.groupBy(F.col("root").alias("name")).agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, F.col("root") == F.col("name")).select(
        F.col("print").alias("known"), "component_id"
    )
    return prints.join(stored(labels, "simhash-labels"), F.col("print") == F.col("known")).select(
        "doc_id", "print", "component_id"
    )


def hex_digits(value: Column) -> Column:
    """16 lower-case hex digits of 64 bits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("print")).alias("fingerprint"), "component_id")
