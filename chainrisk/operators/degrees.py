"""Scores and links over first-, second- and third-degree partners.

Partner scores are aggregated per partner before they travel one hop further,
so a hub with very many partners sends one row per quarter, not one per path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainrisk.functions.values import ratio, sum_or_zero
from chainrisk.operators.histories import Walks, linked_counts, linked_lists, walks
from chainrisk.operators.scores import FIRM_PERIOD, METRICS, firm_universe
from chainrisk.sources.staging import stage

SIDED_PERIOD = ["side", *FIRM_PERIOD]
SIDE_QUARTER = ["side", "year", "quarter"]
#: Links of one firm that a task joins at a time.
HUB_LINKS = 4096


def complete_links(scored: DataFrame) -> DataFrame:
    """Links without any missing value."""
    return scored.dropna("any")


def one_side(df: DataFrame, side: str) -> DataFrame:
    return df.filter(F.col("side") == side).drop("side")


def _to_partner(stats: DataFrame) -> DataFrame:
    return stats.withColumnRenamed("firm_gvkey", "partner_gvkey")


def first_degree_equal(links: DataFrame) -> DataFrame:
    """Mean partner score per side, firm and quarter."""
    return links.groupBy(*SIDED_PERIOD).agg(*[F.avg(f"partner_{m}").alias(m) for m in METRICS])


def first_degree_value(weighted: DataFrame) -> DataFrame:
    """Sum of sales-weighted partner scores."""
    return weighted.groupBy(*SIDED_PERIOD).agg(
        *[sum_or_zero(f"partner_{m}_weighted").alias(m) for m in METRICS]
    )


def second_degree_paths(links: DataFrame, first: DataFrame) -> DataFrame:
    """The partner's own first-degree score, one row per firm-partner link."""
    hops = links.select(*SIDED_PERIOD, "partner_gvkey")
    return hops.join(_to_partner(first), ["side", "partner_gvkey", "year", "quarter"]).select(
        *SIDED_PERIOD, *METRICS
    )


def second_degree_equal(links: DataFrame, first: DataFrame) -> DataFrame:
    return (
        second_degree_paths(links, first)
        .groupBy(*SIDED_PERIOD)
        .agg(*[F.avg(m).alias(m) for m in METRICS])
    )


def third_degree_equal(links: DataFrame, first: DataFrame) -> DataFrame:
    """Mean over all two-hop paths of the end firm's first-degree score.

    Sums and counts of paths are built per middle firm, so paths are never
    listed.  A firm without any scored path keeps a row of NULLs.
    """
    totals = (
        second_degree_paths(links, first)
        .groupBy(*SIDED_PERIOD)
        .agg(*[F.sum(m).alias(f"{m}_sum") for m in METRICS], F.count(F.lit(1)).alias("paths"))
    )
    hops = links.select(*SIDED_PERIOD, "partner_gvkey")
    reached = hops.join(_to_partner(totals), ["side", "partner_gvkey", "year", "quarter"], "left")
    return reached.groupBy(*SIDED_PERIOD).agg(
        *[ratio(F.sum(f"{m}_sum"), F.sum("paths")).alias(m) for m in METRICS]
    )


def firm_degree_table(links: DataFrame, degrees: Sequence[DataFrame]) -> DataFrame:
    """All degree scores of a firm-quarter in one row.

    ``degrees`` holds the first, second, ... degree frames.  They are stacked
    and spread by side and degree in a single grouping: one shuffle in place
    of one join per column group.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [d.select(F.lit(i).alias("degree"), *SIDED_PERIOD, *METRICS) for i, d in enumerate(degrees, 1)],
    )
    spread = []
    for i in range(1, len(degrees) + 1):
        for side in ("supplier", "customer"):
            here = (F.col("degree") == i) & (F.col("side") == side)
            spread += [F.max(F.when(here, F.col(m))).alias(f"degree{i}_{side}_{m}") for m in METRICS]
    return firm_universe(links).join(
        stacked.groupBy(*FIRM_PERIOD).agg(*spread), FIRM_PERIOD, "left"
    )


def has_degree(degree: int, metric: str = "pol") -> Column:
    """Is a score of this degree known on either side?"""
    return F.coalesce(
        f"degree{degree}_supplier_{metric}", f"degree{degree}_customer_{metric}"
    ).isNotNull()


def covered(table: DataFrame, degrees: Sequence[int]) -> DataFrame:
    return table.filter(reduce(lambda a, b: a & b, [has_degree(d) for d in degrees]))


def coverage_counts(table: DataFrame) -> DataFrame:
    """Firms in all, with two degrees and with three degrees."""
    firm = F.col("firm_gvkey")
    two = has_degree(1) & has_degree(2)
    per_firm = table.groupBy(firm).agg(
        F.max(F.when(two, 1).otherwise(0)).alias("two"),
        F.max(F.when(two & has_degree(3), 1).otherwise(0)).alias("three"),
    )
    return per_firm.agg(
        F.count(F.lit(1)).alias("firms"),
        F.coalesce(F.sum("two"), F.lit(0)).alias("firms_two_degrees"),
        F.coalesce(F.sum("three"), F.lit(0)).alias("firms_three_degrees"),
    )


def coverage_by_year(table: DataFrame, degrees: Sequence[int] = (1, 2, 3)) -> DataFrame:
    return covered(table, degrees).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def scored_coverage(table: DataFrame) -> DataFrame:
    """Firm-quarters with three degrees and a score of their own, and their firms, per year and in all.

    ``table`` is a degree table with ``scorevalue``; the row with a NULL year is the total.
    """
    kept = covered(table, (1, 2, 3)).filter(F.col("scorevalue").isNotNull())
    per_firm = kept.groupBy("year", "firm_gvkey").agg(F.count(F.lit(1)).alias("rows"))
    yearly = per_firm.groupBy("year").agg(F.count(F.lit(1)).alias("firms"), F.sum("rows").alias("n"))
    total = per_firm.groupBy("firm_gvkey").agg(F.sum("rows").alias("rows")).agg(
        F.lit(None).cast("int").alias("year"), F.count(F.lit(1)).alias("firms"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")
    )
    return yearly.unionByName(total)


def firm_first_degree_table(links: DataFrame, equal: DataFrame, value: DataFrame) -> DataFrame:
    """Equal- and value-weighted first-degree scores of a firm-quarter in one row."""
    named = {"ew": equal, "vw": value}
    stacked = reduce(
        DataFrame.unionByName,
        [d.select(F.lit(w).alias("weight"), *SIDED_PERIOD, *METRICS) for w, d in named.items()],
    )
    spread = [
        F.max(F.when((F.col("weight") == w) & (F.col("side") == side), F.col(m))).alias(f"degree1_{w}_{side}_{m}")
        for w in named
        for side in ("supplier", "customer")
        for m in METRICS
    ]
    return firm_universe(links).join(stacked.groupBy(*FIRM_PERIOD).agg(*spread), FIRM_PERIOD, "left")


def _numbered_ends(base: DataFrame) -> DataFrame:
    """An ``id`` for every firm of a side and quarter; neighbours in that order share blocks of 64."""
    end = F.explode(F.array("firm_gvkey", "partner_gvkey")).alias("firm")
    ends = base.select(*SIDE_QUARTER, end).distinct()
    ranged = ends.repartitionByRange(*SIDE_QUARTER, "firm").sortWithinPartitions(*SIDE_QUARTER, "firm")
    return stage(ranged.withColumn("id", F.monotonically_increasing_id()), "degree-firms")


def _linked_ids(base: DataFrame, firms: DataFrame) -> DataFrame:
    """Links by id: ``via`` to ``next``."""
    number = lambda end, name: firms.select(
        *SIDE_QUARTER, F.col("firm").alias(end), F.col("id").alias(name)
    )
    edges = (
        base.join(number("firm_gvkey", "via"), [*SIDE_QUARTER, "firm_gvkey"])
        .join(number("partner_gvkey", "next"), [*SIDE_QUARTER, "partner_gvkey"])
        .select("via", "next")
    )
    return stage(edges, "degree-edges")


def _hop(reached: DataFrame, step: DataFrame, hubs: DataFrame) -> DataFrame:
    """Starts one hop further: a row of 64 starts meets each link of its node once per chunk."""
    return (
        reached.withColumnRenamed("node", "via")
        .join(hubs, "via", "left")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("chunks", F.lit(1)) - 1)))
        .join(step, ["via", "chunk"])
        .groupBy(F.col("next").alias("node"), "block")
        .agg(F.bit_or("starts").alias("starts"))
    )


class Reach(NamedTuple):
    """Numbered links of :func:`reach`, and which of 64 starts reach a firm (``node``) in one and two hops."""

    base: DataFrame
    firms: DataFrame
    edges: DataFrame
    hubs: DataFrame
    step: DataFrame
    one: DataFrame
    two: DataFrame


def reach(links: DataFrame, hub_links: int = HUB_LINKS) -> Reach:
    """Firms numbered, and the starts of one and two hops as bits.  Runs jobs and stages tables.

    The links of a firm with more than ``hub_links`` of them are dealt over several tasks.
    """
    base = stage(links.select("firm_gvkey", "partner_gvkey", *SIDE_QUARTER).distinct(), "degree-1")
    firms = _numbered_ends(base)
    edges = _linked_ids(base, firms)
    chunks = F.ceil(F.count(F.lit(1)) / hub_links).cast("bigint").alias("chunks")
    hubs = stage(edges.groupBy("via").agg(chunks).filter("chunks > 1"), "degree-hubs")
    dealt = F.pmod(F.xxhash64("next"), F.coalesce("chunks", F.lit(1).cast("bigint")))
    step = stage(edges.join(hubs, "via", "left").select("via", "next", dealt.alias("chunk")), "degree-step")
    bit = F.expr("shiftleft(1L, CAST(via & 63 AS INT))")
    one = edges.groupBy(F.col("next").alias("node"), F.expr("shiftright(via, 6)").alias("block")).agg(
        F.bit_or(bit).alias("starts")
    )
    return Reach(base, firms, edges, hubs, step, one, stage(_hop(one, step, hubs), "degree-2"))


def degree_links(links: DataFrame, hub_links: int = HUB_LINKS) -> DataFrame:
    """Distinct partners at one, two and three hops, long.

    Columns: side, degree, firm, partner, year, quarter.  Links without a
    firm, partner or period have no further hop.  Runs jobs and stages tables; a task merges
    about ``hub_links`` links at a time.
    """
    return listed_links(walks(links, hub_links))


def listed_links(walked: Walks) -> DataFrame:
    """The rows of :func:`degree_links`: tasks walk two and three hops and list what they reach.

    Pairs are neither shuffled nor staged.
    """
    base = walked.base.select("firm_gvkey", "partner_gvkey", *SIDE_QUARTER, F.lit(1).alias("degree"))
    listed = linked_lists(walked).withColumn("partner_gvkey", F.explode("partners"))
    return base.unionByName(listed.select(*base.columns))


def cycle_links(reached: Reach) -> DataFrame:
    """The rows of ``link_cycles(degree_links(...))`` without the third hop and without listing pairs.

    A firm comes back after n + 1 hops if a firm that it reaches in n hops has a link to it: one
    look-up of its bit per link.
    """
    columns = ["firm_gvkey", "partner_gvkey", *SIDE_QUARTER, "degree"]
    found = [reached.base.filter(F.col("firm_gvkey") == F.col("partner_gvkey")).withColumn("degree", F.lit(1)).select(*columns)]
    back = reached.edges.select(F.col("via").alias("node"), F.expr("shiftright(next, 6)").alias("block"), "next")
    for degree, hop in ((2, reached.one), (3, reached.two)):
        closed = back.join(hop, ["node", "block"]).where("getbit(starts, CAST(next & 63 AS INT)) = 1")
        home = closed.select(F.col("next").alias("id")).distinct().join(reached.firms, "id")
        home = home.withColumns({"firm_gvkey": F.col("firm"), "partner_gvkey": F.col("firm"), "degree": F.lit(degree)})
        found.append(home.select(*columns))
    return reduce(DataFrame.unionByName, found)


def link_cycles(degree_link: DataFrame) -> DataFrame:
    """Firms that come back among their own partners."""
    return degree_link.filter(F.col("firm_gvkey") == F.col("partner_gvkey"))


def mean_partner_count(degree_link: DataFrame | Walks) -> DataFrame:
    """Mean number of distinct partners per firm-quarter; none counts as zero.

    Links are distinct and every firm-quarter has some link, so counting rows
    per firm-quarter and averaging covers the whole universe.  Packed links are counted
    without being listed.
    """
    if isinstance(degree_link, Walks):
        first = degree_link.base.groupBy(*SIDED_PERIOD).agg(F.count(F.lit(1)).alias("n"))
        counted = first.withColumn("degree", F.lit(1)).unionByName(linked_counts(degree_link))
    else:
        counted = degree_link.withColumn("n", F.lit(1).cast("bigint"))
    groups = {f"{s}_{d}": (s, d) for s in ("supplier", "customer") for d in (1, 2, 3)}
    counts = counted.groupBy(*FIRM_PERIOD).agg(
        *[
            sum_or_zero(F.when((F.col("side") == s) & (F.col("degree") == d), F.col("n"))).alias(name)
            for name, (s, d) in groups.items()
        ]
    )
    means = counts.agg(*[F.avg(name).alias(name) for name in groups])
    return means.unpivot([], list(groups), "group", "avg_partners").select(
        F.substring_index("group", "_", 1).alias("side"),
        F.substring_index("group", "_", -1).cast("int").alias("degree"),
        "avg_partners",
    )
