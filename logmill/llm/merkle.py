"""Merkle manifest of a dataset: a tree of digests for each group, and one over the groups.

Each level is a slot pivot: conditional aggregates spread a parent's children into one
column for each slot. All columns in a row are what the parent's digest is taken of; all
but one are that child's siblings. A manifest therefore proves a row by the siblings on
its way up, without any other row.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import UPPER, crc_fold, lower_ascii, read_table, stored
from logmill.llm.ranking import ranked

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after the other, as lower-case hex; NULL parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def spelled(value: Column) -> Column:
    """A value so that it can be told from its neighbours: byte count, colon, text; or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(*map(spelled, values))


def _group(column: Column) -> Column:
    """A group's name that is never NULL and keeps the order, NULL first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


@dataclass
class Tree:
    """Levels from the leaves' parents up, each a row for a parent: ``tree``, ``pos``,
    ``total`` (children of the whole level), the slots ``s0``.. and ``digest``."""

    levels: list[DataFrame]
    fanout: int

    @property
    def tops(self) -> DataFrame:
        """``tree``, ``digest``: what remains of every tree."""
        found = [level.filter(F.col("total") <= self.fanout).select("tree", "digest") for level in self.levels]
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionAll(part)
        return whole


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of ``tree``, ``pos``, ``total``, ``item`` with a child's item in each slot."""
    slot = F.col("pos") % fanout
    slots = [F.max(F.when(slot == k, F.col("item"))).alias(f"s{k}") for k in range(fanout)]
    parents = nodes.groupBy("tree", F.floor(F.col("pos") / fanout).alias("parent")).agg(
        F.max("total").alias("total"), *slots
    )
    joined = digest(*[F.col(f"s{k}.digest") for k in range(fanout)])
    # A lone leaf is the tree; it has no parent of its own.
    own = F.when(F.col("total") == 1, F.col("s0.digest")).otherwise(joined)
    return parents.withColumnRenamed("parent", "pos").withColumn("digest", own)


def build(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """The tree over ``tree``, ``pos``, ``total`` and ``item``, a struct with ``digest``.

    As many levels as the largest tree has; a tree that is finished takes no part in more.
    """
    if fanout < 2:
        raise ValueError("a parent has two children at least")
    levels = [stored(_pivot(leaves, fanout), "merkle")]
    most = levels[0].agg(F.max("total")).first()[0] or 0
    while most > fanout:
        most = -(-most // fanout)
        nodes = levels[-1].filter(F.col("total") > fanout).select(
            "tree", "pos", F.ceil(F.col("total") / fanout).alias("total"), F.struct("digest").alias("item")
        )
        levels.append(stored(_pivot(nodes, fanout), "merkle"))
    return Tree(levels, fanout)


def _children(level: DataFrame, fanout: int) -> DataFrame:
    """Each child of the level's rows with the way up from it, in ``path``: the siblings left
    and right of every node from the child to the top."""
    rows = []
    names = [f"s{k}" for k in range(fanout)]
    for k, name in enumerate(names):
        beside = F.struct(
            F.concat_ws("", *[F.col(f"{s}.digest") for s in names[:k]]).alias("left"),
            F.concat_ws("", *[F.col(f"{s}.digest") for s in names[k + 1 :]]).alias("right"),
        )
        path = F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(F.array(beside), F.col("path")))
        child = F.struct((F.col("pos") * fanout + k).alias("at"), F.col(name).alias("item"), path.alias("up"))
        rows.append(F.when(F.col(name).isNotNull(), child))
    return (
        level.select("tree", "carried", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r"))
        .select("tree", "carried", F.col("r.at").alias("pos"), F.col("r.item").alias("item"), F.col("r.up").alias("path"))
    )


def paths(tree: Tree, tops: DataFrame) -> DataFrame:
    """``tree``, ``pos``, ``item``, ``path``, ``carried`` of every leaf.

    ``tops`` has ``tree``, ``path``, the way up from its top, and ``carried``, handed down as
    it is. Ways are handed down a level at a time, from a parent's row to all its children.
    """
    tops = tops.select(F.col("tree").alias("of"), "path", "carried")
    below = None
    for level in reversed(tree.levels):
        found = level.filter(F.col("total") <= tree.fanout).join(tops, F.col("tree") == F.col("of")).drop("of")
        if below is not None:
            known = below.select(F.col("tree").alias("of"), F.col("pos").alias("at"), "path", "carried")
            met = level.join(known, (F.col("tree") == F.col("of")) & (F.col("pos") == F.col("at")))
            found = found.unionByName(met.drop("of", "at"))
        below = _children(found, tree.fanout)
    return below


_NO_PATH = "CAST(array() AS array<struct<left:string,right:string>>)"


@dataclass
class Manifest:
    """``groups``: tree of each group; ``top``: the tree over the groups."""

    groups: Tree
    top: Tree

    def root(self) -> str | None:
        """The digest of everything; None of an empty table."""
        row = self.top.tops.first()
        return row and row["digest"]

    def proofs(self) -> DataFrame:
        """``item``, ``path``, ``group``, ``subroot``, ``root`` for every row.

        ``path`` leads from the row's leaf over its group's top to the root.
        """
        start = self.top.tops.select("tree", F.expr(_NO_PATH).alias("path"), F.struct(F.col("digest").alias("root")).alias("carried"))
        above = paths(self.top, start).select(
            F.col("item.group").alias("tree"),
            "path",
            F.struct("item.group", F.col("item.digest").alias("subroot"), "carried.root").alias("carried"),
        )
        return paths(self.groups, stored(above, "merkle-tops")).select("item", "path", "carried.*")


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    key: str = "doc_id",
    group: str = "source",
    fanout: int = FANOUT,
    extra: Column | None = None,
) -> Manifest:
    """The manifest of ``docs``: a leaf is the digest of ``columns``, NULL or not; leaves of a
    group stand by ``key`` (NULL first, then by digest), groups by name (NULL first).

    Leaves keep ``key`` and ``extra``, a column of the caller's. Texts are hashed where they
    are read and never shuffled. Repeated rows are leaves of their own; an empty table has
    no root.
    """
    item = F.struct(
        leaf_digest([F.col(f"`{c}`") for c in columns]).alias("digest"),
        F.col(f"`{key}`").alias("key"),
        (F.lit(None).cast("string") if extra is None else extra).alias("extra"),
    )
    leaves = docs.select(_group(F.col(f"`{group}`")).alias("tree"), item.alias("item"))
    order = [F.col("item.key"), F.col("item.digest"), F.col("item.extra")]
    groups = build(ranked(leaves, "tree", order, "merkle"), fanout)
    subroots = groups.tops.select(F.lit(0).alias("tree"), F.struct("digest", F.col("tree").alias("group")).alias("item"))
    return Manifest(groups, build(ranked(subroots, "tree", [F.col("item.group")], "merkle-top"), fanout))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its way up give."""
    return F.aggregate(path, leaf, lambda at, step: digest(step["left"], at, step["right"]))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on the way up."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether it holds once some texts are tampered with.

    A NULL id is never tampered with. Documents that are equal in all columns are leaves of
    their own, with siblings of their own.
    """
    docs = read_table(spark, sf_dir, "documents")
    tampered = [lower_ascii(F.col("text")) if c == "text" else F.col(c) for c in COLUMNS]
    altered = F.when(crc_fold(F.col("doc_id"), 5) == 0, leaf_digest(tampered))
    proofs = manifest(docs, extra=altered).proofs()
    folded = fold(F.coalesce("item.extra", "item.digest"), F.col("path"))
    return proofs.select(
        F.col("item.key").alias("doc_id"),
        F.col("item.digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# CRC-32 of decimal digits, bit by bit: DuckDB has no function for it.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''),
    lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _spelled_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_spelled_sql(text if c == 'text' else c) for c in COLUMNS)})"


def _up_sql(name: str, start: str) -> str:
    return f"""{name} AS (
    {start}
    UNION ALL
    SELECT tree, level + 1, list_transform(range(0, len(nodes), {FANOUT}),
        lambda i: sha256(array_to_string(nodes[i + 1:i + {FANOUT}], ''))) FROM {name} WHERE len(nodes) > 1
)"""


def _steps_sql(stage: int, leaves: str, levels: str) -> str:
    run = f"nodes[(pos // {FANOUT} ** level // {FANOUT}) * {FANOUT} + 1:(pos // {FANOUT} ** level // {FANOUT}) * {FANOUT} + {FANOUT}]"
    run = run.replace(f"{FANOUT} ** level", "(1 << (4 * level))")
    slot = "pos // (1 << (4 * level)) % 16"
    return f"""SELECT number, {stage} AS stage, level, array_to_string(({run})[1:{slot}], '') AS l,
        array_to_string(({run})[{slot} + 2:{FANOUT}], '') AS r
    FROM {leaves} JOIN {levels} USING (tree) WHERE len(nodes) > 1"""


OP11_SQL = f"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN {CRC32_SQL.format("doc_id")} % 5 = 0
        THEN {_leaf_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS altered FROM documents),
p AS (SELECT *, row_number() OVER () AS number,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_up_sql("levels", "SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY tree")},
subroots AS (SELECT tree AS name, nodes[1] AS subroot, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos
    FROM levels WHERE len(nodes) = 1),
{_up_sql("tops", "SELECT tree, 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots GROUP BY tree")},
above AS (SELECT p.number, s.pos, s.tree FROM p JOIN subroots s ON p.tree = s.name),
steps AS ({_steps_sql(0, "p", "levels")} UNION ALL {_steps_sql(1, "above", "tops")}),
ways AS (SELECT number, sha256(string_agg(l || r, '' ORDER BY stage, level)) AS proof,
    list({{'l': l, 'r': r}} ORDER BY stage, level) AS way FROM steps GROUP BY number),
found AS (SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
    coalesce(proof, sha256('')) AS proof_sha256,
    list_reduce(list_prepend({{'l': coalesce(altered, leaf), 'r': ''}}, coalesce(way, [])),
        lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root
    FROM p JOIN subroots s ON p.tree = s.name LEFT JOIN ways USING (number))
SELECT *, folded_root = root AS verified FROM found
"""
