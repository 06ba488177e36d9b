"""Exact top-k inner-product search with ball trees.

Vectors are split into shards, each a file with a ball tree: nodes hold a centre and a
radius, leaves a few vectors. A task takes a block of queries through some shards. It
visits nodes in the order of ``q . centre + |q| * radius``, the most that any vector in
the ball can score, and leaves out a node for every query whose k-th score so far is
above that. The k-th scores go along from shard to shard; before, each block has been
through one shard, and the k-th scores found there are shared by all tasks of the block.

Blocks meet groups of shards by path, in rows of a few kB, dealt out to a bounded number of
tasks; trees and queries are read from the shared store where they are used. No list of
files passes through the driver.
"""

import heapq
import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmill.llm import files
from logmill.llm.common import read_table, stored
from logmill.sources.shared import shared_folder

SCALE, QUERY_EVERY, TOP = 64, 20, 20
# Vectors of a shard and of a leaf, queries of a block, shards of a group (on average).
SHARD, LEAF, BLOCK, GROUP = 8192, 64, 512, 16
# Most tasks that pairs of a block and a group are dealt out to.
TASKS = 20_000
_LEAST = np.iinfo(np.int64).min
_EXACT_DOUBLE, _LONG = float(1 << 53), float(1 << 63)


def quantized(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``parts``, floor(SCALE * x) of each component.

    Rows without an id, NULL vectors and vectors with a NULL or non-finite component are
    left out.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("parts"),
    )


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of equal width; shorter ones end in zeros."""
    width = max(map(len, rows), default=0)
    matrix = np.zeros((len(rows), width), np.int64)
    for line, row in zip(matrix, rows, strict=True):
        line[: len(row)] = row
    return matrix


def _pack(**arrays: np.ndarray) -> bytes:
    data = io.BytesIO()
    np.savez_compressed(data, **arrays)
    return data.getvalue()


def _unpack(path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(files.read_bytes(path))) as arrays:
        return dict(arrays)


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Node tables over vectors in leaf order; children of node i in ``left`` and ``right``."""
    points = vectors.astype(np.float64)
    order = np.arange(len(ids))
    spans, left, right = [(0, len(ids))], [-1], [-1]
    centres, radii = [], []
    node = 0
    while node < len(spans):
        start, end = spans[node]
        part = points[order[start:end]]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        centres.append(centre)
        radii.append(away.max())
        if end - start > LEAF and radii[-1] > 0:
            # Halves along the line between two far points.
            one = part[away.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argsort(part @ (other - one), kind="stable")]
            left[node], right[node] = len(spans), len(spans) + 1
            spans += [(start, start + half), (start + half, end)]
            left += [-1, -1]
            right += [-1, -1]
        node += 1
    starts, ends = np.array(spans, np.int64).T
    return {
        "ids": ids[order],
        "vectors": vectors[order],
        "start": starts,
        "end": ends,
        "left": np.array(left),
        "right": np.array(right),
        "centre": np.array(centres),
        "radius": np.array(radii),
    }


def _write_rows(rows: DataFrame, folder: str, kind: str, size: int, pack) -> DataFrame:
    """Files of at most ``size`` rows each, as ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def flush() -> pa.RecordBatch:
            data = pack(np.array(ids, np.int64), _matrix(parts))
            name = f"{kind}-{TaskContext.get().partitionId():06d}"
            return pa.RecordBatch.from_pydict({"path": [files.write_bytes(folder, name, data)]})

        for batch in batches:
            column = batch.column("parts")
            for key, row in zip(batch.column("vec_id").to_pylist(), column, strict=True):
                ids.append(key)
                parts.append(row.values.to_numpy())
                if len(ids) == size:
                    yield flush()
                    ids, parts = [], []
        if ids:
            yield flush()

    return stored(rows.mapInArrow(run, "path string"), f"{kind}-paths")


@dataclass
class Block:
    """Queries with their best answers so far, best first."""

    ids: np.ndarray
    queries: np.ndarray
    scores: np.ndarray
    found: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], top: int, floor: np.ndarray | None) -> "Block":
        count = len(arrays["ids"])
        return cls(
            arrays["ids"],
            arrays["vectors"],
            np.full((count, top), _LEAST),
            np.full((count, top), np.iinfo(np.int64).max),
            np.full(count, _LEAST) if floor is None else floor,
        )

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in scores (rows x ids); a query's own id is no answer."""
        own = ids == self.ids[rows][:, None]
        scores = np.where(own, _LEAST, scores)
        named = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        named = np.concatenate([self.found[rows], named], axis=1)
        # The complement turns the order round without overflow.
        best = np.lexsort((named, ~scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[rows] = np.take_along_axis(scores, best, axis=1)
        self.found[rows] = np.take_along_axis(named, best, axis=1)


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond a long stay at its end."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0))
    most *= max(1, queries.shape[1])
    if most < _EXACT_DOUBLE:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if most < _LONG:
        return queries @ vectors.T
    limits = np.iinfo(np.int64)
    return np.clip(queries.astype(object) @ vectors.T.astype(object), limits.min + 1, limits.max).astype(np.int64)


def search_tree(block: Block, tree: dict[str, np.ndarray]) -> None:
    """Take the block's queries through a tree, best bound first."""
    width = max(block.queries.shape[1], tree["vectors"].shape[1])
    queries, vectors = _widened(block.queries, width), _widened(tree["vectors"], width)
    centres = _widened(tree["centre"], width)
    points = queries.astype(np.float64)
    lengths = np.sqrt((points**2).sum(axis=1))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        most = points[rows] @ centres[node] + lengths[rows] * tree["radius"][node]
        # Rounding must not cut off a vector on the ball's edge.
        slack = 1e-9 * lengths[rows] * (np.linalg.norm(centres[node]) + tree["radius"][node]) + 1e-6
        return np.maximum(most + slack, float(_LEAST))  # scores end there as well

    agenda: list = []
    tie = itertools.count()

    def offer(node: int, rows: np.ndarray) -> None:
        most = bound(node, rows)
        rows, most = rows[open_ := most >= block.kth()[rows]], most[open_]
        if len(rows):
            heapq.heappush(agenda, (-most.max(), next(tie), node, rows, most))

    offer(0, np.arange(len(block.ids)))
    while agenda:
        *_, node, rows, most = heapq.heappop(agenda)
        rows = rows[most >= block.kth()[rows]]  # the k-th scores may have risen since
        if not len(rows):
            continue
        if tree["left"][node] >= 0:
            offer(tree["left"][node], rows)
            offer(tree["right"][node], rows)
        else:
            inside = slice(tree["start"][node], tree["end"][node])
            block.merge(rows, tree["ids"][inside], _products(queries[rows], vectors[inside]))


def write_index(vectors: DataFrame, folder: str) -> DataFrame:
    """Shards of ``vec_id``, ``parts`` rows, as ``path``."""
    return _write_rows(vectors, folder, "tree", SHARD, lambda ids, rows: _pack(**build_tree(ids, rows)))


def search(queries: DataFrame, index: DataFrame, folder: str, top: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the best ``top`` answers of every query.

    Answers are all indexed vectors but those with the query's id; equal scores are
    ranked by id. Fewer vectors give fewer answers, none an empty result. Vectors of
    other widths count as if they ended in zeros. Scores beyond a long stay at its end.
    Of queries with one id, the one with the smallest parts is taken; indexed rows with one id are answers each.
    """
    spark = queries.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("parts").alias("parts"))
    blocks = _write_rows(asked, folder, "queries", BLOCK, lambda ids, rows: _pack(ids=ids, vectors=rows))
    groups = -(-index.count() // GROUP)
    schema = "query_id bigint, vec_id bigint, score bigint"
    if not groups:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(_unpack(row["path"]), top, None)
                if row["shard"] is not None:
                    search_tree(block, _unpack(row["shard"]))
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "kth": [block.kth().tobytes()]})

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(_unpack(row["path"]), top, np.frombuffer(row["kth"], np.int64))
                for shard in row["shards"]:
                    search_tree(block, _unpack(shard))
                line, place = np.nonzero((block.scores > _LEAST) & (block.scores >= block.floor[:, None]))
                columns = (block.ids[line], block.found[line, place], block.scores[line, place])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    def place(path: str):
        return F.pmod(F.xxhash64(path), F.lit(groups)).cast("int")

    listed = index.groupBy(place("path").alias("number")).agg(F.sort_array(F.collect_list("path")).alias("shards"))
    listed = stored(listed, "shard-lists")
    # Any shard will do; different blocks take different ones. None, if the group has none.
    some = listed.select("number", F.get("shards", F.lit(0)).alias("shard"))
    count = blocks.count()
    started = blocks.select("path", place("path").alias("wanted")).join(some, F.col("wanted") == F.col("number"), "left")
    started = started.select("path", "shard").repartition(min(TASKS, max(1, count)), "path")
    first = stored(started.mapInArrow(first_scores, "path string, kth binary"), "first-scores")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("wanted")
    met = first.select("path", "kth", every).join(listed, F.col("wanted") == F.col("number"))
    spread = met.repartition(min(TASKS, max(1, count * groups)), "path", "number")
    found = spread.select("path", "kth", "shards").mapInArrow(rest, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def op6_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best answers of every QUERY_EVERY-th vector among all vectors."""
    vectors = quantized(read_table(spark, sf_dir, "embeddings"))
    folder = shared_folder(spark, "ball-trees")
    index = write_index(vectors, folder)
    return search(vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), index, folder)


OP6_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS p
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.p) + 1), lambda i: q.p[i] * c.p[i])) AS BIGINT) AS score
    FROM v q, v c WHERE q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair) WHERE rank <= {TOP}
"""
