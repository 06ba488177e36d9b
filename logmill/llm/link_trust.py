"""URL filter: rules, and trust spread over the link graph of hosts.

Pages that a rule fits are allowed or blocked by it. Such pages are the seeds of two
personalised PageRanks over links between hosts: trust flows from hosts of allowed pages
along links, distrust flows from hosts of blocked pages against the links, to those that
link to them. Both are kept in seed pages: the trust of all hosts sums up to the number
of allowed pages. A host is blocked if its distrust is more than ``THRESHOLD`` times its
trust; hosts that neither reaches are allowed.

Built-in expressions, joins and grouping only; ranks are tables, written each round.
"""

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import free, lower_ascii, read_table, stored

DAMPING, THRESHOLD = 0.85, 1.0
# Rounds at most; None, the default, has no bound: rounds end when ranks have settled.
ROUNDS: int | None = None
# Hops of one round; ranks are written and compared once a round.
STEPS = 4
# Share of its own rank by which any host may still grow when the rounds end.
SETTLED = 1e-6
# A rank this small still tells that a host is reached; products of shares below it are 0.
LEAST_RANK = 2.0**-1022
# Rules are part of the expression; a list beyond this should be a table of hosts.
MOST_RULES = 1000
ALLOW, BLOCK = "allow", "block"
# A tag ends where the next begins, so that junk without ``>`` is read once.
_HREF = r"""(?i)<a\s(?:[^<>]*?\s)?href\s*+=\s*+["']?+\s*+(?:https?:)?+//([^/?#"'\s<>\\]++)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        """Whether host is the rule's or below it, and path begins with the rule's."""
        below = (host == self.host) | host.endswith(f".{self.host}")
        return below & path.startswith(self.path)


# The rules of the query.
RULES = [
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
]


def url_host(url: Column) -> Column:
    """After the first ``://``, A-Z in lower case; empty without one."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _by_rule(rules: list[Rule], value) -> Column:
    """``value`` of the longest rule that fits; of equally long ones, a blocking rule's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == BLOCK, r.name)):
        found = F.when(rule.fits(F.col("host"), F.col("path")), F.lit(value(rule))).otherwise(found)
    return found


def judged_by_rule(pages: DataFrame, rules: list[Rule], keep: list[str], url: str = "url") -> DataFrame:
    """Kept columns as the struct ``kept``, ``host``, ``path``, ``rule`` and ``by_rule``, its verdict."""
    kept = F.struct(*keep) if keep else F.lit(0)
    rows = pages.select(kept.alias("kept"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    return rows.withColumn("rule", _by_rule(rules, lambda r: r.name)).withColumn(
        "by_rule", _by_rule(rules, lambda r: r.verdict)
    )


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``source``, ``target``, ``links``: how often pages of a host link to another host."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_HREF), F.lit(1)))
    found = pages.select(url_host(F.col(url)).alias("source"), F.explode(links).alias("target"))
    found = found.withColumn("target", lower_ascii(F.col("target")))
    return (
        found.filter((F.col("source") != "") & (F.col("source") != F.col("target")))
        .groupBy("source", "target")
        .agg(F.count("*").alias("links"))
    )


def _flows(links: DataFrame) -> DataFrame:
    """Edges of both ranks: trust along links, distrust against them; shares of ``origin`` sum to 1."""
    forward = links.select(F.lit(ALLOW).alias("kind"), F.col("source").alias("origin"), F.col("target").alias("goal"), "links")
    backward = links.select(F.lit(BLOCK).alias("kind"), F.col("target").alias("origin"), F.col("source").alias("goal"), "links")
    flows = forward.union(backward)
    total = flows.groupBy(F.col("kind").alias("k"), F.col("origin").alias("o")).agg(F.sum("links").alias("all"))
    return flows.join(total, (F.col("kind") == F.col("k")) & (F.col("origin") == F.col("o"))).select(
        "kind", "origin", "goal", (F.col("links") / F.col("all")).alias("share")
    )


def propagate(links: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of every host that either reaches.

    ``seeds`` has ``kind`` (allow or block), ``host`` and ``mass``. What flows into hosts
    without links of their own goes back to the seeds: ranks are added up from flows that
    start with the seeds' mass, then scaled to it. They only grow; rounds end when no host
    is reached anew and none grows by more than ``SETTLED`` of itself, however many rounds
    that takes (and after ``rounds``, if given). Without links, the seeds keep their mass;
    without seeds, the result is empty.
    """
    seeds = stored(seeds, "seeds")
    flows = stored(_flows(links), "flows")
    masses = {r["kind"]: r["mass"] for r in seeds.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
    started = seeds.select("kind", "host", F.col("mass").alias("rank"))
    ranks = stored(started.withColumn("was", F.lit(0.0)), "ranks")
    for _ in itertools.count() if rounds is None else range(rounds):
        new = ranks.select("kind", "host", "rank")
        for _ in range(STEPS):
            moved = flows.join(
                new.select(F.col("kind").alias("k"), "host", "rank"), (F.col("kind") == F.col("k")) & (F.col("origin") == F.col("host"))
            ).select("kind", F.col("goal").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
            rank = F.greatest(F.sum("rank"), F.lit(LEAST_RANK)).alias("rank")
            new = started.union(moved).groupBy("kind", "host").agg(rank)
        before = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
        both = new.withColumn("was", F.lit(0.0)).union(before).groupBy("kind", "host")
        new = stored(both.agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "ranks")
        grown = new.agg(F.max((F.col("rank") - F.col("was")) / F.col("rank"))).first()[0] or 0.0
        free(ranks)
        ranks = new
        if grown <= SETTLED:
            break
    sums = {r["kind"]: r["rank"] for r in ranks.groupBy("kind").agg(F.sum("rank").alias("rank")).collect()}

    def of(kind: str) -> Column:
        scale = masses[kind] / sums[kind] if kind in sums else 0.0
        return F.sum(F.when(F.col("kind") == kind, F.col("rank") * scale).otherwise(0.0))

    return ranks.groupBy("host").agg(of(ALLOW).alias("trust"), of(BLOCK).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """Kept columns, ``host``, ``path``, ``rule``, ``trust``, ``distrust``, ``verdict`` of every page row.

    URLs that are NULL or lack ``://`` have an empty host and path: no rule fits, no link
    counts, and they are allowed. NULL and empty texts have no links. Repeated rows stay
    and count as often as they occur. Kept columns named like a result give way to it.
    """
    results = ("host", "path", "rule", "trust", "distrust", "verdict")
    kept = [c for c in keep if c not in results]
    rows = judged_by_rule(pages, rules, kept, url)
    seeds = (
        judged_by_rule(pages, rules, [], url)
        .filter(F.col("by_rule").isNotNull() & (F.col("host") != ""))
        .groupBy(F.col("by_rule").alias("kind"), "host")
        .agg(F.count("*").cast("double").alias("mass"))
    )
    hosts = propagate(host_links(pages, url, html), seeds).withColumnRenamed("host", "known")
    # Rows without a host get keys of their own, so that they spread.
    wanted = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("/"), F.monotonically_increasing_id()))
    met = rows.withColumn("wanted", wanted).join(hosts, F.col("wanted") == F.col("known"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    by_links = F.when(distrust > THRESHOLD * trust, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return met.select(
        *[F.col("kept")[c].alias(c) for c in kept],
        "host",
        "path",
        "rule",
        trust.alias("trust"),
        distrust.alias("distrust"),
        F.coalesce("by_rule", by_links).alias("verdict"),
    )


def op3_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(read_table(spark, sf_dir, "pages"), RULES, ["page_id"])
