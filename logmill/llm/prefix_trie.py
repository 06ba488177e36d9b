"""Trie of shared conversation prefixes, from sorted conversations.

Conversations are sorted by their turns; neighbours' longest common prefixes (LCPs) are an
array, and a prefix's members are the run around it in which no LCP is shorter than the
prefix. A sparse table answers the minimum over any range of LCPs, so each candidate prefix
finds both ends of its run by binary search, on its own, without a stack.

The sorted conversations are cut into blocks. A prefix that runs over a block's end is a
piece in each block it touches; all figures of a node are sums or minima over its pieces,
and only the pieces of such prefixes, at most two conversations' length for each block, are
grouped.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmill.llm.common import crc_fold, read_table, stored
from logmill.llm.merkle import CRC32_SQL

# Turns of a block: what a task holds at once, with some 200 bytes for each.
BLOCK_TURNS = 1 << 20
# A turn's key is its MD5.
KEY = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_PIECE = (
    "part long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "parent_conv_id long, node string, parent string, ends string"
)


def turn_key(role: Column, text: Column) -> Column:
    """Hex MD5 of a turn; of the role's length too, so that role and text cannot run together."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, ``path`` (the turns' keys in a row) and ``sizes`` (bytes of their texts).

    By turn, NULL first; turns of one number by their keys. NULL role or text is empty; rows
    without a conversation are left out. Texts are hashed before the shuffle: a conversation
    is one row of some 24 bytes a turn.
    """
    of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"), turn_key(of(role), of(text)).alias("key"), F.octet_length(of(text)).cast("bigint").alias("size")
    )
    rows = turns.select(F.col(f"`{conv}`").cast("bigint").alias("conv_id"), one.alias("one")).filter("conv_id IS NOT NULL")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.select(
        "conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.size").alias("sizes")
    )


def rebuilt(convs: DataFrame, base: Column, shared: Column) -> DataFrame:
    """Each conversation with its first ``shared`` turns replaced by those of conversation
    ``base``: all it has if fewer, none if it is absent."""
    other = convs.select(F.col("conv_id").alias("of"), F.col("path").alias("first"), F.col("sizes").alias("first_sizes"))
    met = convs.withColumns({"base": base, "shared": shared}).join(other, F.col("base") == F.col("of"), "left")
    n = F.size("sizes")
    path = F.concat(
        F.coalesce(F.substring("first", F.lit(1), F.col("shared") * KEY), F.lit(b"")),
        F.substring("path", F.col("shared") * KEY + 1, F.greatest(n - F.col("shared"), F.lit(0)) * KEY),
    )
    sizes = F.concat(
        F.coalesce(F.slice("first_sizes", 1, F.col("shared")), F.array().cast("array<bigint>")),
        F.slice("sizes", F.col("shared") + 1, F.greatest(n - F.col("shared"), F.lit(0))),
    )
    return met.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k has the minimum of the 2^k values from each place on."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    return levels


def right_end(minima: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place up to which all LCPs after ``at`` reach ``depth``, by binary search."""
    at = at.copy()
    for k in range(len(minima) - 1, -1, -1):
        reach = at + (1 << k)
        fits = reach < len(minima[0])
        start = np.where(fits, at + 1, 0)
        fits &= minima[k][np.minimum(start, len(minima[k]) - 1)] >= depth
        at[fits] = reach[fits]
    return at


def left_end(minima: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place from which all LCPs up to ``at`` reach ``depth``, by binary search."""
    at = at.copy()
    for k in range(len(minima) - 1, -1, -1):
        reach = at - (1 << k)
        fits = reach >= 0
        start = np.where(fits, reach + 1, 0)
        fits &= minima[k][np.minimum(start, len(minima[k]) - 1)] >= depth
        at[fits] = reach[fits]
    return at


def common_prefixes(keys: np.ndarray, lens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """LCP in turns of each conversation with the one before; 0 for the first."""
    row = np.repeat(np.arange(len(lens)), lens)
    depth = np.arange(len(keys)) - offs[row]
    before = np.maximum(row - 1, 0)
    both = (row > 0) & (depth < lens[before])
    same = both & (keys == keys[np.where(both, offs[before] + depth, 0)]).all(axis=1) if len(keys) else both
    lcps = np.zeros(len(lens), dtype=np.int64)
    filled = np.flatnonzero(lens)
    if len(filled):
        lcps[filled] = np.minimum.reduceat(np.where(same, lens[row], depth), offs[filled])
    lcps[0] = 0
    return lcps


def _prefix_names(path: bytes, most: int) -> list[str]:
    """Names of a conversation's prefixes of 0 to ``most`` turns."""
    hashed, names = hashlib.md5(), []
    for depth in range(most + 1):
        names.append(f"{depth}:{hashed.hexdigest()}")
        hashed.update(path[depth * KEY : (depth + 1) * KEY])
    return names


def block_pieces(paths: pa.Array, sizes: pa.Array, ids: np.ndarray, left: int, right: int) -> dict[str, object]:
    """Columns of ``_PIECE`` but ``part`` for one block of sorted conversations.

    ``left`` and ``right`` are the LCPs with the neighbours in the next blocks, -1 without.
    """
    n = len(ids)
    lens = np.asarray(pc.binary_length(paths)).astype(np.int64) // KEY
    offs = np.concatenate([[0], np.cumsum(lens)])[:-1]
    blob = b"".join(p.as_py() for p in paths)
    keys = np.frombuffer(blob, dtype="<u8").reshape(-1, 2)
    weights = np.asarray(sizes.flatten()).astype(np.int64)
    lcps = common_prefixes(keys, lens, offs)
    minima = range_minima(lcps)

    # Candidates: the prefixes that a conversation is the block's first to have.
    lowest = np.where(np.arange(n) == 0, 0, lcps + 1)
    counts = lens - lowest + 1
    starts = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(n), counts)
    depth = np.arange(starts[-1]) - starts[row] + lowest[row]
    last = right_end(minima, row, depth)
    above = left_end(minima, row, depth - 1)
    parent = np.where(depth > 0, starts[above] + depth - 1 - lowest[above], -1)
    members = last - row + 1
    open_left = (row == 0) & (depth <= left)
    open_right = (last == n - 1) & (depth <= right)

    # The smallest id of a run, by a sparse table over the ids.
    least = range_minima(ids)
    level = np.frexp(members.astype(np.float64))[1] - 1
    smallest = np.empty(len(row), dtype=np.int64)
    for k in np.unique(level):
        at = level == k
        smallest[at] = np.minimum(least[k][row[at]], least[k][last[at] + 1 - (1 << int(k))])

    # Nodes lie in pre-order: a node's subtree is what comes up to the run's end.
    end = starts[last + 1]
    size = np.where(depth > 0, np.append(weights, 0)[np.minimum(offs[row] + depth - 1, len(weights))], 0)
    within = lambda values: (total := np.concatenate([[0], np.cumsum(values)]))[end] - total[:-1]
    # A node counts once: as a child and for its first copy in its first piece, as a leaf in
    # its last, for the shorter of its conversations come first.
    saved = within(members * size - np.where(open_left, 0, size))
    leaves = within((lens[last] == depth) & ~open_right)
    children = np.bincount(parent[(depth > 0) & ~open_left], minlength=len(row))

    crossing = open_left | open_right
    names: dict[int, str] = {}
    for border, most in ((0, left), (n - 1, right)):
        for d, name in enumerate(_prefix_names(paths[border].as_py(), min(most, int(lens[border])))):
            lo = int(left_end(minima, np.array([border]), np.array([d]))[0])
            names[int(starts[lo] + d - lowest[lo])] = name
    alike = np.zeros(n, dtype=bool)
    alike[1:] = (lcps[1:] == lens[1:]) & (lens[1:] == lens[:-1])
    run_end = np.append(np.flatnonzero(~alike)[1:], n)[np.cumsum(~alike) - 1]
    ends: list[str | None] = []
    for node, (lo, is_end, is_open) in enumerate(zip(row.tolist(), (depth == lens[row]).tolist(), crossing.tolist())):
        text = ",".join(map(str, ids[lo : run_end[lo]].tolist())) if is_end else ""
        if is_open:
            ends.append(text or None)
        else:
            ends.append(hashlib.sha256(text.encode()).hexdigest() if text else _EMPTY)
    outer = np.where(parent >= 0, crossing[parent], False).tolist()
    inner = (parent >= 0) & ~np.array(outer, dtype=bool)
    return {
        "depth": depth,
        "conv_id": smallest,
        "n_convs": members,
        "n_children": children,
        "n_leaves": leaves,
        "saved_tokens": saved,
        "parent_conv_id": pa.array(smallest[parent], mask=~inner),
        "node": pa.array([names[k] if c else None for k, c in enumerate(crossing.tolist())], pa.string()),
        "parent": pa.array([names[p] if o else None for p, o in zip(parent.tolist(), outer)], pa.string()),
        "ends": pa.array(ends, pa.string()),
    }


def _shared_turns(one: bytes, other: bytes) -> int:
    a, b = (np.frombuffer(x, dtype="<u8").reshape(-1, 2) for x in (one, other))
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _borders(blocks: DataFrame) -> dict[int, tuple[int, int]]:
    """LCPs of each block's ends with its neighbours: two numbers for each of the blocks.

    One task reads two conversations of each block, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                common = -1 if last is None else _shared_turns(last[1], row["first"])
                yield pa.RecordBatch.from_pydict({"part": [row["part"]], "common": [common]})
                last = row["part"], row["last"]

    ends = blocks.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    found = ends.coalesce(1).sortWithinPartitions("part").mapInArrow(run, "part long, common long")
    rows = sorted(map(tuple, found.collect()))
    after = [common for _, common in rows[1:]] + [-1]
    return {part: (common, right) for (part, common), right in zip(rows, after)}


def _hash_in_order(texts: DataFrame) -> DataFrame:
    """``node``, ``ends``: SHA-256 of a node's texts by ``part``, comma-joined, a text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = hashed = None
        for batch in batches:
            for name, text in zip(batch.column("of").to_pylist(), batch.column("text")):
                if name != node:
                    if node is not None:
                        yield pa.RecordBatch.from_pydict({"of": [node], "sha": [hashed.hexdigest()]})
                    node, hashed = name, hashlib.sha256(text.as_py().encode())
                else:
                    hashed.update(b"," + text.as_py().encode())
        if node is not None:
            yield pa.RecordBatch.from_pydict({"of": [node], "sha": [hashed.hexdigest()]})

    # One row for each block that a node touches.
    return texts.repartition("of").sortWithinPartitions("of", "part").mapInArrow(run, "of string, sha string")


def trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie over ``conv_id``, ``path``, ``sizes`` (ids differ, no NULLs).

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (NULL for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` of the ids of members that
    end in the node. An empty table has no nodes; equal conversations share all of theirs.
    A conversation that very many share is one run over many blocks.
    """
    convs = stored(convs, "trie-conversations")
    turns = convs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    spark = convs.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    order = [F.col("path"), F.col("conv_id")]
    blocks = convs.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id().cast("bigint"))
    blocks = stored(blocks, "trie-blocks")
    borders = _borders(blocks)

    def pieces(block: pa.Table) -> pa.Table:
        part = block.column("part")[0].as_py()
        block = block.combine_chunks()
        ids, paths, sizes = (block.column(c).combine_chunks() for c in ("conv_id", "path", "sizes"))
        order = pc.sort_indices(block.select(["path", "conv_id"]), [("path", "ascending"), ("conv_id", "ascending")])
        columns = block_pieces(paths.take(order), sizes.take(order), np.asarray(ids.take(order)), *borders[part])
        return pa.table({"part": np.full(len(columns["depth"]), part), **columns})

    found = stored(blocks.groupBy("part").applyInArrow(pieces, _PIECE), "trie-pieces")
    whole = found.filter("node IS NULL")
    cut = found.filter("node IS NOT NULL")
    ends = _hash_in_order(cut.filter("ends IS NOT NULL").select(F.col("node").alias("of"), "part", F.col("ends").alias("text")))
    merged = cut.groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("parent").alias("parent"),
    )
    merged = merged.join(ends, F.col("node") == F.col("of"), "left").withColumn("ends", F.coalesce("sha", F.lit(_EMPTY)))
    merged = stored(merged.drop("of", "sha"), "trie-merged")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    settled = whole.filter("parent IS NULL").select("parent_conv_id", *columns)
    waiting = whole.filter("parent IS NOT NULL").select("parent", *columns).union(merged.select("parent", *columns))
    names = merged.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    linked = waiting.join(names, F.col("parent") == F.col("of"), "left").select("parent_conv_id", *columns)
    return settled.union(linked).select(
        "conv_id", "depth", "parent_conv_id", *columns[2:-1], F.col("ends").alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each behind the first turns of another."""
    convs = stored(sequences(read_table(spark, sf_dir, "conversations")), "conversations")
    conv = F.col("conv_id")
    return trie(rebuilt(convs, conv - conv % 5, crc_fold(conv, 9)))


OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key, size) AS keys,
    list(size ORDER BY turn NULLS FIRST, key, size) AS sizes FROM t GROUP BY conv_id),
h AS (SELECT *, {CRC32_SQL.format("conv_id")} % 9 AS shared FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.keys[1:shared], []), h.keys[shared + 1:]) AS keys,
    list_concat(coalesce(b.sizes[1:shared], []), h.sizes[shared + 1:]) AS sizes
    FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d AS depth, array_to_string(keys[1:d], '') AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size,
    len(keys) = d AS ends FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM r)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM m GROUP BY path, depth),
c AS (SELECT left(path, 32 * (CAST(depth AS INT) - 1)) AS path, depth - 1 AS depth, count(*) AS n_children
    FROM n WHERE depth > 0 GROUP BY ALL),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path, depth)),
a AS (SELECT left(path, 32 * CAST(j AS INT)) AS path, j AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum((n_convs - 1) * size) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM k) GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN a USING (path, depth) LEFT JOIN k p ON p.depth = k.depth - 1 AND p.path = left(k.path, 32 * CAST(p.depth AS INT))
"""
