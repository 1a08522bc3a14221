"""Declines of partner scores: who is supplied by, or sells to, a firm in decline.

A partner may have several scores in one period, and each of them is kept.
Fills therefore run on one row per link and period, which the calendar bounds; the
scores of a partner, one row for all periods, are joined before and spread afterwards.  In row order (period, then
score) the value carried forward from a period is its largest score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainrisk.functions.calendar import quarter_index
from chainrisk.functions.values import nan_to_null
from chainrisk.functions.windows import forward_fill, lagged
from chainrisk.operators.histories import Declines, Walks

LINK = ["side", "degree", "firm_gvkey", "partner_gvkey"]
#: Parts that the links of a partner are dealt over, and the key of a link's history: numbers
#: first, since rows are sorted by it.
PARTS = 8
HISTORY = ["partner_gvkey", "part", "firm_gvkey", "side", "degree"]


def _mapped(scores: DataFrame, companies: DataFrame) -> DataFrame:
    firms = companies.select("gvkey", "institutionid")
    return nan_to_null(scores.join(firms, "institutionid", "left"))


# Score types and dimension names of the source.
def esg_scores(trucost: DataFrame, companies: DataFrame) -> DataFrame:
    """Overall modelled scores by firm, year and quarter."""
    rows = trucost.filter(
        (F.col("scoretype") == "S&P Global ESG Score") & (F.col("csascoretypename") == "Modeled")
    )
    return _dated(rows, companies)


def _environmental_rows(trucost: DataFrame) -> DataFrame:
    return trucost.filter(
        (F.col("dimensionname") == "Environmental Dimension")
        & (F.col("csascoretypename") == "Modeled")
        & (F.col("scoretype") == "Dimension")
        & (F.col("aspectname") == "Environmental Dimension")
        & (F.col("mostrecentsequence") == 1)
    )


def _dated(rows: DataFrame, companies: DataFrame) -> DataFrame:
    kept = rows.distinct().select("scoredate", "scorevalue", "institutionid")
    return (
        _mapped(kept, companies)
        .withColumns({"year": F.year("scoredate"), "quarter": F.quarter("scoredate")})
        .dropna("any")
    )


def environmental_scores(trucost: DataFrame, companies: DataFrame) -> DataFrame:
    """Modelled environmental scores by firm, year and quarter."""
    return _dated(_environmental_rows(trucost), companies)


def environmental_scores_by_year(trucost: DataFrame, companies: DataFrame) -> DataFrame:
    kept = (
        _environmental_rows(trucost).distinct().select("assessmentyear", "scorevalue", "institutionid")
    )
    return _mapped(kept, companies).dropna("any")


def _series(scores: DataFrame, period: Column) -> DataFrame:
    """One row per partner and part of its links: the distinct scores of every period, ascending."""
    own = scores.select(F.col("gvkey").alias("partner_gvkey"), period.alias("t"), F.col("scorevalue").alias("score"))
    at = own.filter(F.col("t").isNotNull() & F.col("score").isNotNull()).groupBy("partner_gvkey", "t")
    by_period = at.agg(F.sort_array(F.collect_set("score")).alias("scores"))
    pairs = F.map_from_entries(F.collect_list(F.struct("t", "scores")))
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    return by_period.groupBy("partner_gvkey").agg(pairs.alias("series")).select("*", part)


def _with_series(links: DataFrame, series: DataFrame) -> DataFrame:
    """Link periods of partners with scores, dealt once by partner and part of the firms.

    The deal serves the join and the windows over links; the parts spread the links of a
    partner that very many firms reach.  All shuffle partitions are kept: links shrink on
    disk far more than in the sorts that follow.
    """
    partitions = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("firm_gvkey"), F.lit(PARTS)).cast("int")
    dealt = links.withColumn("part", part).repartition(partitions, "partner_gvkey", "part")
    return dealt.join(series, ["partner_gvkey", "part"])


def _repeated() -> Column:
    """Is the link's row before of the same period?"""
    return lagged("t", 1, HISTORY, ["t"]) == F.col("t")


def fill_firm_scores(table: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores on a firm table, carried forward over quarters without one."""
    period = quarter_index("year", "quarter")
    mine = scores.select(F.col("gvkey").alias("firm_gvkey"), period.alias("t"), F.col("scorevalue").alias("score"))
    top = mine.groupBy("firm_gvkey", "t").agg(F.max("score").alias("top"))
    filled = forward_fill("top", ["firm_gvkey"], ["t"])
    keyed = table.withColumn("t", period)
    # Firm rows repeat per quarter only by their own scores: fill on distinct quarters.
    quarters = keyed.select("firm_gvkey", "t").distinct().join(top, ["firm_gvkey", "t"], "left")
    return (
        keyed.join(quarters.withColumn("filled", filled).drop("top"), ["firm_gvkey", "t"])
        .join(mine, ["firm_gvkey", "t"], "left")
        .withColumn("scorevalue", F.coalesce("score", "filled"))
        .drop("t", "filled", "score")
    )


def quarterly_decline(links: DataFrame | Walks, scores: DataFrame) -> DataFrame | Declines:
    """Partner score against the same quarter of the year before.

    Both are carried forward along the link's own quarters; rows without one
    of them are dropped.  Declines of packed links are not listed (:func:`listed_declines`).
    """
    if isinstance(links, Walks):
        return Declines(links, _firm_scores(scores, "year", "quarter"), yearly=False)
    rows = links.select(*LINK, "year", "quarter", quarter_index("year", "quarter").alias("t"))
    found = _with_series(rows, _series(scores, quarter_index("year", "quarter")))
    filled = (
        found.withColumns({"own": F.col("series")[F.col("t")], "last": F.col("series")[F.col("t") - 4]})
        .drop("series")
        .withColumns(
            {
                "own_fill": forward_fill(F.array_max("own"), HISTORY, ["t"]),
                "last_fill": forward_fill(F.array_max("last"), HISTORY, ["t"]),
                "repeated": F.coalesce(_repeated(), F.lit(False)),
            }
        )
        .filter(F.col("own_fill").isNotNull() & F.col("last_fill").isNotNull() & ~F.col("repeated"))
    )
    return (
        filled.withColumn("scorevalue", F.explode(F.coalesce("own", F.array("own_fill"))))
        .withColumn("lst_score", F.explode(F.coalesce("last", F.array("last_fill"))))
        .select(*LINK, "year", "quarter", "scorevalue", "lst_score", _declined().alias("decline"))
    )


def _declined() -> Column:
    return F.when(F.col("scorevalue") < F.col("lst_score"), 1).otherwise(0)


def annual_decline(links: DataFrame | Walks, scores: DataFrame) -> DataFrame | Declines:
    """Partner score against the link's previous row, in year and score order.

    Declines of packed links are not listed (:func:`listed_declines`).
    """
    if isinstance(links, Walks):
        scores = scores.withColumn("year", F.col("assessmentyear").cast("int"))
        return Declines(links, _firm_scores(scores, "year"), yearly=True)
    found = _with_series(
        links.select(*LINK, F.col("year").alias("t")), _series(scores, F.col("assessmentyear").cast("int"))
    )
    filled = (
        found.withColumn("own", F.col("series")[F.col("t")])
        .drop("series")
        .withColumns(
            {
                "fill": forward_fill(F.array_max("own"), HISTORY, ["t"]),
                "repeated": F.coalesce(_repeated(), F.lit(False)),
            }
        )
        .filter(F.col("fill").isNotNull() & ~F.col("repeated"))
        .withColumn("before", lagged("fill", 1, HISTORY, ["t"]))
    )
    # Each score of a year follows the one below it, the least one what the link had before.
    own = F.coalesce("own", F.array("fill"))
    earlier = F.concat(F.array("before"), F.slice(own, 1, F.size(own) - 1))
    return (
        filled.select(*LINK, F.col("t").alias("year"), F.explode(F.arrays_zip(own.alias("score"), earlier.alias("lower"))).alias("s"))
        .select(*LINK, "year", F.col("s.score").alias("scorevalue"), F.col("s.lower").alias("lst_score"))
        .select("*", _declined().alias("decline"))
        .dropna("any")
    )


def _firm_scores(scores: DataFrame, *period: str) -> DataFrame:
    score = F.col("scorevalue").cast("double").alias("score")
    return scores.select(F.col("gvkey").alias("firm"), *[F.col(p).cast("int").alias(p) for p in period], score)


def _loose(declines: Declines) -> DataFrame | None:
    """Quarterly declines of the links without a side or firm, which are not packed."""
    links = declines.walks.loose
    if links is None or declines.yearly:
        return None
    scores = declines.scores.select(F.col("firm").alias("gvkey"), "year", "quarter", F.col("score").alias("scorevalue"))
    return quarterly_decline(links.withColumn("degree", F.lit(1)), scores)


def _with_loose(found: DataFrame, declines: Declines, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    loose = _loose(declines)
    return found if loose is None else found.unionByName(of(loose).select(*found.columns))


def _rows(declines: Declines, rate: bool) -> DataFrame:
    period = ["year"] if declines.yearly else ["year", "quarter"]
    listed = declines.lists(rate).select("side", "degree", "firm_gvkey", *period, "decline_rate", F.inline("rows"))
    scores = ["scorevalue", "lst_score", "decline"]
    return listed.select(*LINK, *period, *scores, *(["decline_rate"] if rate else []))


def listed_declines(declines: Declines) -> DataFrame:
    """One row per decline; tasks list them, and no pair is shuffled or staged."""
    return _with_loose(_rows(declines, False), declines, lambda loose: loose)


def _firm_period(df: DataFrame) -> list[str]:
    return ["side", "degree", "firm_gvkey", "year"] + (["quarter"] if "quarter" in df.columns else [])


def firm_decline_rate(declines: DataFrame | Declines) -> DataFrame:
    """Share of declining partner rows per firm and period."""
    if isinstance(declines, Declines):
        sums = declines.rates()
        sums = sums.drop("quarter") if declines.yearly else sums
        rates = sums.select(*_firm_period(sums), (F.col("declines") / F.col("n")).alias("decline_rate"), "n")
        return _with_loose(rates, declines, firm_decline_rate)
    return declines.groupBy(*_firm_period(declines)).agg(
        F.avg("decline").alias("decline_rate"), F.count(F.lit(1)).alias("n")
    )


def with_decline_rate(declines: DataFrame | Declines) -> DataFrame:
    """Every row with its firm's rate; aggregated first, then joined back.

    A task that works out the declines has all rows of a firm, so nothing is joined.
    """
    if isinstance(declines, Declines):
        return _with_loose(_rows(declines, True), declines, with_decline_rate)
    rates = firm_decline_rate(declines).drop("n")
    return declines.join(rates, _firm_period(declines))


def decline_rate_summary(declines: DataFrame | Declines) -> DataFrame:
    """Mean over quarters of mean, deviation, quartiles and median of the rates.

    Quartiles work on the frequency of each distinct rate, so that the state of a
    quarter follows the number of different rates, not of firms.
    """
    by = ["side", "degree", "year", "quarter"]
    rates = firm_decline_rate(declines)
    moments = rates.groupBy(*by).agg(
        F.avg("decline_rate").alias("mean"), F.stddev_samp("decline_rate").alias("std")
    )
    quantiles = [
        F.expr(f"percentile(decline_rate, {p}D, w)").alias(name)
        for name, p in (("q25", 0.25), ("q75", 0.75), ("median", 0.5))
    ]
    weighted = rates.groupBy(*by, "decline_rate").agg(F.count(F.lit(1)).alias("w"))
    places = weighted.groupBy(*by).agg(*quantiles)
    names = ["mean", "std", "q25", "q75", "median"]
    return (
        moments.join(places, by).groupBy("side", "degree").agg(*[F.avg(c).alias(c) for c in names])
    )


def decline_coverage(declines: DataFrame | Declines) -> DataFrame:
    """Distinct firms and distinct partners of each side's and degree's decline table."""
    by = ["side", "degree"]
    if isinstance(declines, Declines):
        ends = declines.ends().select(*by, "firm_gvkey", "is_partner")
        both = F.explode(F.array(F.struct("firm_gvkey", F.lit(False).alias("is_partner")), F.struct(F.col("partner_gvkey").alias("firm_gvkey"), F.lit(True).alias("is_partner"))))
        ends = _with_loose(ends, declines, lambda loose: loose.select(*by, both.alias("end")).select(*by, "end.*")).distinct()
        count = lambda partner: F.count(F.when(F.col("is_partner") == partner, F.col("firm_gvkey")))
        return ends.filter(F.col("side").isNotNull()).groupBy(*by).agg(count(False).alias("firms"), count(True).alias("partners"))
    firms = declines.groupBy(*by).agg(F.count_distinct("firm_gvkey").alias("firms"))
    partners = declines.groupBy(*by).agg(F.count_distinct("partner_gvkey").alias("partners"))
    return firms.join(partners, by)


def firm_decline_flag(declines: DataFrame | Declines) -> DataFrame:
    """1 where more than half of the firm's partner rows decline."""
    rates = firm_decline_rate(declines)
    return rates.withColumn("flag", F.when(F.col("decline_rate") > 0.5, 1).otherwise(0)).drop(
        "decline_rate", "n"
    )


def flagged_share(declines: DataFrame | Declines) -> DataFrame:
    """Share of firm-periods that carry the flag."""
    return firm_decline_flag(declines).groupBy("side", "degree").agg(F.avg("flag").alias("share"))


# Names of the flag columns.
FLAG_COLUMNS = {
    (s, d): f"{word}_degree_{s}_env_decline"
    for s in ("supplier", "customer")
    for d, word in ((1, "first"), (2, "second"), (3, "third"))
}


def decline_flags_wide(flags: DataFrame) -> DataFrame:
    """Six flags per firm and period in one row; an absent flag is zero."""
    period = [c for c in ("firm_gvkey", "year", "quarter") if c in flags.columns]
    return flags.groupBy(*period).agg(
        *[
            F.coalesce(
                F.max(F.when((F.col("side") == s) & (F.col("degree") == d), F.col("flag"))), F.lit(0)
            ).alias(name)
            for (s, d), name in FLAG_COLUMNS.items()
        ]
    )
