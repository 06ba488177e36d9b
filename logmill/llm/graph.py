"""Connected components of a link table, by joins and grouping alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import free, stored


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """``edges`` with ``least``: the smallest of node ``u`` and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select(F.col("u").alias("node"), F.least("u", "least").alias("least"))
    return edges.join(least, F.col("u") == F.col("node")).drop("node")


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _smallest_neighbour(both).filter("v > u")
    return _distinct_edges(found.select(F.col("v").alias("u"), F.col("least").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _smallest_neighbour(down)
    smaller = found.select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = found.select("u", F.col("least").alias("v"))
    return _distinct_edges(smaller.union(own))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the undirected edges ``u``, ``v``.

    The root is the smallest node that can be reached. Large stars and small stars take
    turns until nothing changes, a number of rounds that grows with the logarithm of the
    node count. The rows in between are written and reread each round, and those of the
    round before removed. A node's
    smallest neighbour is combined before the shuffle, and the join that hands it back
    has no grouping on the same key above it, so a node with very many links is split.
    An empty table has no nodes. NULL ends are left out.
    """
    edges = stored(_distinct_edges(edges.select("u", "v").dropna()), "edges")
    state = None
    while True:
        before, edges = edges, stored(_small_star(_large_star(edges)), "edges")
        free(before)
        # Equal rows give an equal sum of hashes whatever their order.
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == state:
            break
        state = sign
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
