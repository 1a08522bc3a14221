"""Firm scores, disclosed links, value weights and larger-partner shares.

Links are kept long: one row per ``side`` (supplier or customer), firm,
partner and quarter.  One plan then serves both sides and all three scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainrisk.functions.values import as_id, clip_negative, keep_keys, larger_flag, ratio, sum_or_zero
from chainrisk.operators.combinations import AnnualSales, listed_sides

METRICS = ["pol", "covid", "cc"]
KEY = ["gvkey", "year", "quarter"]
FIRM_PERIOD = ["firm_gvkey", "year", "quarter"]
QUARTERS = (1, 2, 3, 4)
#: Firm and partner of a sales row, by side.
SALE_ENDS = {"supplier": ("GVKEY2", "GVKEY1"), "customer": ("GVKEY1", "GVKEY2")}


def score_panel(pol: DataFrame, cc: DataFrame) -> DataFrame:
    """Mean political, pandemic and climate score per firm and quarter.

    Both tables are stacked and averaged in one grouping; a mean skips the
    rows of the other table.  Rows whose firm is not a number are left out.
    """
    exposure = pol.select(
        as_id("gvkey").alias("gvkey"),
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.col("Risk").alias("pol"),
        F.col("Covid_Exposure").alias("covid"),
    )
    climate = cc.select(
        as_id("gvkey").alias("gvkey"), "year", "quarter", F.col("cc_expo_ew").alias("cc")
    )
    stacked = exposure.unionByName(climate, allowMissingColumns=True)
    return keep_keys(stacked, *KEY).groupBy(*KEY).agg(*[F.avg(m).alias(m) for m in METRICS])


def _both_sides(df: DataFrame, *carried: str) -> DataFrame:
    """A sales row seen by its customer (supplier side) and by its supplier."""
    seller, buyer = F.col("GVKEY1"), F.col("GVKEY2")
    views = F.array(
        F.struct(
            F.lit("supplier").alias("side"),
            buyer.alias("firm_gvkey"),
            seller.alias("partner_gvkey"),
        ),
        F.struct(
            F.lit("customer").alias("side"),
            seller.alias("firm_gvkey"),
            buyer.alias("partner_gvkey"),
        ),
    )
    return df.select(F.explode(views).alias("v"), *carried).select("v.*", *carried)


def disclosed_links(sales: DataFrame) -> DataFrame:
    """Annual customer-sales rows at each quarter, from both sides."""
    known = keep_keys(sales, "GVKEY1", "GVKEY2").withColumns(
        {"year": F.col("y").cast("int"), "sale_cs": F.col("SALECS")}
    )
    return _both_sides(known, "year", "sale_cs").withColumn(
        "quarter", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)]))
    )


def attach_scores(links: DataFrame, panel: DataFrame, min_year: int) -> DataFrame:
    """Scores of the firm and of the partner, from ``min_year`` on.

    Distinct links and distinct scores give distinct rows, so only the narrow links are
    made distinct.
    """
    recent = links.filter(F.col("year") >= min_year).distinct()
    scores = panel.filter(F.col("year") >= min_year).select(*KEY, *METRICS).distinct()
    for role in ("firm", "partner"):
        mine = scores.select(
            F.col("gvkey").alias(f"{role}_gvkey"),
            "year",
            "quarter",
            *[F.col(m).alias(f"{role}_{m}") for m in METRICS],
        )
        recent = recent.join(mine, [f"{role}_gvkey", "year", "quarter"], "left")
    return recent


def sales_totals(sales: DataFrame) -> DataFrame:
    """Sales of a firm to its customers and from its suppliers per year."""
    clipped = sales.withColumns(
        {"year": F.col("y").cast("int"), "sale": clip_negative("SALECS")}
    )
    by = ["side", "firm_gvkey", "year"]
    return keep_keys(_both_sides(clipped, "year", "sale"), *by).groupBy(*by).agg(
        sum_or_zero("sale").alias("sale_t")
    )


def value_weighted_links(scored: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of the firm's sales and partner scores times that share."""
    return weighted_scores(scored.join(totals, ["side", "firm_gvkey", "year"], "left"))


def weighted_scores(links: DataFrame) -> DataFrame:
    """The firm's share of sales and the partner's scores times that share."""
    return links.withColumn("sale_r", ratio("sale_cs", "sale_t")).withColumns(
        {f"partner_{m}_weighted": F.col(f"partner_{m}") * F.col("sale_r") for m in METRICS}
    )


def firm_years(panel: DataFrame, totals: DataFrame) -> DataFrame:
    """Scores of all four quarters and both sales totals of a firm and year in one row."""
    stacked = panel.withColumnRenamed("gvkey", "firm_gvkey").unionByName(totals, allowMissingColumns=True)
    scores = [
        F.max(F.when(F.col("quarter") == q, F.col(m))).alias(f"{m}_{q}") for q in QUARTERS for m in METRICS
    ]
    sales = [F.max(F.when(F.col("side") == side, F.col("sale_t"))).alias(f"sale_t_{side}") for side in SALE_ENDS]
    return stacked.groupBy("firm_gvkey", "year").agg(*scores, *sales)


def scored_sales(sales: DataFrame, firm_year: DataFrame, min_year: int) -> DataFrame:
    """Distinct annual sales with the year of the seller and of the buyer, from ``min_year`` on.

    One row carries what eight quarterly links of both sides need, so that joins move an
    eighth of the rows; :func:`quarterly_links` spreads it without a shuffle.  Sales are dealt
    by seller and year, which serves both the distinct rows and the first join.
    """
    out = (
        keep_keys(sales, "GVKEY1", "GVKEY2")
        .select("GVKEY1", "GVKEY2", F.col("y").cast("int").alias("year"), F.col("SALECS").alias("sale_cs"))
        .filter(F.col("year") >= min_year)
        .repartition("GVKEY1", "year")
        .distinct()
    )
    recent = firm_year.filter(F.col("year") >= min_year)
    for end in ("GVKEY1", "GVKEY2"):
        side = next(s for s, (firm, _) in SALE_ENDS.items() if firm == end)
        mine = recent.select(
            F.col("firm_gvkey").alias(end),
            "year",
            *[F.col(f"{m}_{q}").alias(f"{end}_{m}_{q}") for q in QUARTERS for m in METRICS],
            F.col(f"sale_t_{side}"),
        )
        out = out.join(mine, [end, "year"], "left")
    return out


def quarterly_links(scored: DataFrame) -> DataFrame:
    """Links of both sides and all quarters from :func:`scored_sales`, with shares and weighted scores.

    The rows of ``value_weighted_links`` over ``disclosed_links`` with attached scores.
    """
    sides = []
    for side, (firm, partner) in SALE_ENDS.items():
        at = [
            F.struct(
                F.lit(q).alias("quarter"),
                *[F.col(f"{end}_{m}_{q}").alias(f"{role}_{m}") for role, end in (("firm", firm), ("partner", partner)) for m in METRICS],
            )
            for q in QUARTERS
        ]
        sides.append(
            scored.select(
                F.lit(side).alias("side"),
                F.col(firm).alias("firm_gvkey"),
                F.col(partner).alias("partner_gvkey"),
                "year",
                "sale_cs",
                F.col(f"sale_t_{side}").alias("sale_t"),
                F.explode(F.array(*at)).alias("at"),
            ).select("side", "firm_gvkey", "partner_gvkey", "year", "sale_cs", "sale_t", "at.*")
        )
    return weighted_scores(sides[0].unionByName(sides[1]))


def with_firm_scores(links: DataFrame) -> DataFrame:
    return links.dropna(subset=[f"firm_{m}" for m in METRICS])


def larger_partner_flags(links: DataFrame, weighted: bool = False) -> DataFrame:
    """0/1 per score: is the partner's (weighted) score above the firm's?"""
    tail, suffix = ("_weighted", "_w") if weighted else ("", "")
    return with_firm_scores(links).withColumns(
        {
            f"larger_{m}{suffix}": larger_flag(f"partner_{m}{tail}", f"firm_{m}")
            for m in METRICS
        }
    )


def larger_partner_shares(flagged: DataFrame, weighted: bool = False) -> DataFrame:
    """Share of firms with at least one larger partner, per side and quarter.

    A first grouping per firm makes the distinct counts plain sums.
    """
    suffix = "_w" if weighted else ""
    by = ["side", "year", "quarter"]
    per_firm = flagged.groupBy(*by, "firm_gvkey").agg(
        *[F.max(f"larger_{m}{suffix}").alias(m) for m in METRICS]
    )
    return per_firm.groupBy(*by).agg(
        *[F.avg(m).alias(f"{m}_prop") for m in METRICS], F.count(F.lit(1)).alias("firm_count")
    )


def shares_long(shares: DataFrame) -> DataFrame:
    """One table with a ``metric`` column in place of one sheet per score."""
    named = [f"{m}_prop" for m in METRICS]
    long = shares.unpivot(["side", "year", "quarter", "firm_count"], named, "metric", "prop")
    return long.withColumn(
        "metric", F.concat(F.lit("larger_"), F.col("side"), F.lit("_"), F.col("metric"))
    ).drop("side")


def firm_universe(links: DataFrame) -> DataFrame:
    """Firm-quarters of either side with their own scores."""
    return links.select(*FIRM_PERIOD, *[f"firm_{m}" for m in METRICS]).distinct()


def firm_meta(weighted_links: DataFrame | AnnualSales) -> DataFrame:
    """Firm, supplier and customer side by side with the summed exposure.

    The result holds every supplier-customer combination of a firm-quarter.  Firm-quarters,
    suppliers and customers are made distinct first, so their combinations need no distinct
    and are never shuffled.  Of annual sales, not even their quarterly links are.
    """
    if isinstance(weighted_links, AnnualSales):
        out = listed_sides(weighted_links)
        for side in ("supplier", "customer"):
            out = out.withColumn(side, F.explode_outer(side))
        ends = [F.col(f"{side}.gvkey").alias(f"{side}_gvkey") for side in ("supplier", "customer")]
        sums = [(F.col(f"firm_{m}") + F.col(f"supplier.{m}") + F.col(f"customer.{m}")).alias(f"sc_{m}") for m in METRICS]
        return out.select(*FIRM_PERIOD, *ends, *sums)
    links = with_firm_scores(weighted_links)
    out = firm_universe(links)
    for side in ("supplier", "customer"):
        mine = links.filter(F.col("side") == side).select(
            *FIRM_PERIOD,
            F.col("partner_gvkey").alias(f"{side}_gvkey"),
            *[F.col(f"partner_{m}_weighted").alias(f"{side}_{m}_weighted") for m in METRICS],
        )
        out = out.join(mine.repartition(*FIRM_PERIOD).distinct(), FIRM_PERIOD, "left")
    return out.withColumns(
        {
            f"sc_{m}": F.col(f"firm_{m}")
            + F.col(f"supplier_{m}_weighted")
            + F.col(f"customer_{m}_weighted")
            for m in METRICS
        }
    )


def firm_rows(df: DataFrame, firm: int, column: str = "firm_gvkey") -> DataFrame:
    return df.filter(F.col(column) == firm)
