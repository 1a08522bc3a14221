"""Dated relations to a linked firm-quarter panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainrisk.functions.calendar import (
    index_of_date,
    quarter_end,
    quarter_of_index,
    year_of_index,
)
from chainrisk.functions.text import base_name

OPEN_END = "4000-01-01"  # fixed value: end date of a relation still in force
SIDES = ["SOURCE", "TARGET"]
WORD = 62  # quarters that share one number


def relation_clean(relations: DataFrame, open_end: str) -> DataFrame:
    """Dates parsed and open ends replaced by the last day of the study."""
    end = F.to_date("end_")
    return relations.withColumns(
        {
            "start_": F.to_date("start_"),
            "end_": F.when(end == F.lit(OPEN_END).cast("date"), F.lit(open_end).cast("date"))
            .otherwise(end),
        }
    )


def firm_quarter_grid(relations: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every source firm at every quarter end of the study."""
    first, last = first_year * 4, last_year * 4 + 3
    grid = relations.select("source_company_id").distinct().withColumn(
        "q", F.explode(F.sequence(F.lit(first), F.lit(last)))
    )
    year, quarter = year_of_index("q"), quarter_of_index("q")
    return grid.select(
        "source_company_id",
        year.alias("year"),
        quarter.alias("quarter"),
        quarter_end(year, quarter).alias("date"),
    )


def merged_ranges(ranged: DataFrame, first: str = "_first", last: str = "_last") -> DataFrame:
    """Rows equal in all other columns with their overlapping or adjacent ranges made one.

    A row opens a new range if it starts behind everything before it; null values are equal.
    """
    keys = [c for c in ranged.columns if c not in (first, last)]
    ordered = Window.partitionBy(*keys).orderBy(first, last)
    reach = F.max(last).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col(first) <= reach + 1, 0).otherwise(1)
    numbered = ranged.withColumn("_opens", opens).withColumn(
        "_range", F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = numbered.groupBy(*keys, "_range").agg(F.min(first).alias(first), F.max(last).alias(last))
    return merged.select(*ranged.columns)


def quarter_bits(relations: DataFrame, first: int, last: int) -> DataFrame:
    """Rows equal in all columns but ``_first`` and ``_last`` made one, with the set of their quarters.

    The set of quarters ``first`` to ``last`` is kept as bits of ``WORD`` quarters a column, which a
    hash aggregation merges before and after the shuffle; nothing is sorted.
    """
    keys = [c for c in relations.columns if c not in ("_first", "_last")]
    words = []
    for at in range(first, last + 1, WORD):
        low = F.greatest(F.col("_first") - at, F.lit(0))
        high = F.least(F.col("_last") - at, F.lit(WORD - 1))
        none = F.lit(0).cast("bigint")
        ones = F.call_function("shiftleft", none + 1, high - low + 1) - 1
        bits = F.when(low <= high, F.call_function("shiftleft", ones, low)).otherwise(none)
        words.append(F.bit_or(bits).alias(f"_bits_{at}"))
    return relations.groupBy(*keys).agg(*words)


def relations_in_force(
    relations: DataFrame, first_year: int, last_year: int, open_end: str
) -> DataFrame:
    """One row per pair, type and identifiers with the quarters of the study it is in force, as bits."""
    first, last = first_year * 4, last_year * 4 + 3
    clean = relation_clean(relations, open_end).filter(F.col("target_company_id").isNotNull())
    last_in_force = F.when(
        F.col("end_") == quarter_end(F.year("end_"), F.quarter("end_")), index_of_date("end_")
    ).otherwise(index_of_date("end_") - 1)
    for side in SIDES:
        clean = clean.withColumn(f"{side}_cusip", F.substring(f"{side}_cusip", 1, 8))
    ranged = clean.withColumns(
        {
            "_first": F.greatest(index_of_date("start_"), F.lit(first)),
            "_last": F.least(last_in_force, F.lit(last)),
        }
    ).filter(F.col("_first") <= F.col("_last"))
    return quarter_bits(ranged.drop("start_", "end_"), first, last)


def spread_quarters(merged: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """One row per quarter end that the bits of :func:`relations_in_force` hold.

    What is worked out per row is worked out before this, once and not once a quarter.
    """
    first, last = first_year * 4, last_year * 4 + 3

    def in_word(at: int) -> Column:
        quarters = F.sequence(F.lit(at), F.lit(min(at + WORD - 1, last)))
        return F.filter(quarters, lambda q: F.getbit(F.col(f"_bits_{at}"), q - at) == 1)

    in_force = [in_word(at) for at in range(first, last + 1, WORD)]
    expanded = merged.select(
        *[c for c in merged.columns if not c.startswith("_bits_")], F.explode(F.concat(*in_force)).alias("_q")
    )
    panel = expanded.withColumns(
        {"year": year_of_index("_q"), "quarter": quarter_of_index("_q")}
    ).withColumn("date", quarter_end("year", "quarter"))
    return panel.drop("_q")


def panel_expand(
    relations: DataFrame, first_year: int, last_year: int, open_end: str
) -> DataFrame:
    """One row per pair, type, identifiers and quarter end with a relation in force.

    The quarter range follows from the two dates, so a relation expands inside its own
    row and no join against a calendar is needed.  A pair has many relations in force at
    once: their quarters are merged as bits first, so that no quarter is made twice and the
    rows need no distinct.
    """
    return spread_quarters(relations_in_force(relations, first_year, last_year, open_end), first_year, last_year)


def identified_panel(
    relations: DataFrame, first_year: int, last_year: int, open_end: str
) -> DataFrame:
    """``with_any_identifier(panel_expand(...))``, with names reduced before the quarters are spread."""
    merged = relations_in_force(relations, first_year, last_year, open_end)
    return spread_quarters(with_any_identifier(merged), first_year, last_year)


def with_any_identifier(panel: DataFrame) -> DataFrame:
    """Rows with some identifier on both sides, names reduced to their base."""
    kept = panel
    for side in SIDES:
        ids = F.coalesce(f"{side}_cusip", f"{side}_name", f"{side}_isin")
        kept = kept.filter(ids.isNotNull())
    for side in SIDES:
        kept = kept.withColumn(f"{side}_name", base_name(f"{side}_name"))
    return kept


def _both(kind: str) -> Column:
    return F.col(f"SOURCE_{kind}").isNotNull() & F.col(f"TARGET_{kind}").isNotNull()


def route(panel: DataFrame) -> DataFrame:
    """Best identifier that both sides have: cusip, isin, name or none."""
    return panel.withColumn(
        "route",
        F.when(_both("cusip"), "cusip")
        .when(_both("isin"), "isin")
        .when(_both("name"), "name")
        .otherwise("none"),
    )


def routed(panel: DataFrame, kind: str) -> DataFrame:
    return route(panel).filter(F.col("route") == kind).drop("route")


def _valid_link(df: DataFrame, link: DataFrame, key: str, side: str) -> DataFrame:
    """Add ``<side>_gvkey`` from a dated link table ``(key, gvkey, FNDATE, LNDATE)``."""
    table = link.select(
        F.col(key).alias("_key"), F.col("gvkey").alias(f"{side}_gvkey"), "FNDATE", "LNDATE"
    )
    inside = (F.col("date") <= F.col("LNDATE")) & (F.col("date") >= F.col("FNDATE"))
    return df.join(table, (F.col("_lookup") == F.col("_key")) & inside, "left").drop(
        "_key", "_lookup", "FNDATE", "LNDATE"
    )


def link_cusip(panel: DataFrame, link: DataFrame) -> DataFrame:
    out = routed(panel, "cusip")
    for side in SIDES:
        out = _valid_link(out.withColumn("_lookup", F.col(f"{side}_cusip")), link, "CUSIPH", side)
    return out


def link_isin(panel: DataFrame, link: DataFrame, directory: DataFrame) -> DataFrame:
    """ISIN to registration number, then to the firm valid at the date."""
    out = routed(panel, "isin")
    codes = directory.select(F.col("isin").alias("_isin"), F.col("cikcode").alias("_lookup"))
    for side in SIDES:
        out = out.join(codes, F.col(f"{side}_isin") == F.col("_isin"), "left").drop("_isin")
        out = _valid_link(out, link, "cik", side)
    return out


def link_name(panel: DataFrame, name_link: DataFrame) -> DataFrame:
    """Dated link on the matched company name."""
    out = routed(panel, "name").distinct()
    for side in SIDES:
        out = _valid_link(
            out.withColumn("_lookup", F.col(f"{side}_name")), name_link, "coname", side
        )
    return out


def scored_link_table(link: DataFrame, *score_tables: DataFrame) -> DataFrame:
    """Link rows whose firm occurs in some score table."""
    firms = reduce(DataFrame.unionAll, [t.select("gvkey") for t in score_tables])
    return link.join(firms.filter(F.col("gvkey").isNotNull()).distinct(), "gvkey", "left_semi").distinct()


def panel_names(panel: DataFrame) -> DataFrame:
    """Distinct company names of the rows that only a name can link."""
    rows = routed(panel, "name")
    return rows.select(
        F.explode(F.array(*[f"{s}_name" for s in SIDES])).alias("name")
    ).distinct()


def known_links(*linked: DataFrame) -> DataFrame:
    """Rows with both firms known, over all routes."""
    whole = [
        df.filter(F.col("SOURCE_gvkey").isNotNull() & F.col("TARGET_gvkey").isNotNull())
        for df in linked
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), whole)


def links_union(*linked: DataFrame) -> DataFrame:
    """The known links without repeats."""
    return known_links(*linked).distinct()


def sided_links(linked: DataFrame) -> DataFrame:
    """Linked relations as ``(side, firm_gvkey, partner_gvkey, year, quarter)``."""
    return linked.select(
        F.when(F.col("rel_type") == "SUPPLIER", "supplier")
        .when(F.col("rel_type") == "CUSTOMER", "customer")
        .alias("side"),
        F.col("SOURCE_gvkey").alias("firm_gvkey"),
        F.col("TARGET_gvkey").alias("partner_gvkey"),
        "year",
        "quarter",
    ).filter(F.col("side").isNotNull()).distinct()
