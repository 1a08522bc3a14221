"""Market and accounting controls, excess returns and the regression sample.

Daily or monthly rows are first reduced to one row per security and period,
which the calendar bounds; lags, leads and rolling products run on those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainrisk.functions.calendar import (
    business_day_two_quarters_back,
    month_of_quarter,
    quarter_index,
)
from chainrisk.functions.values import product_or_one, product_strict, ratio, sum_or_zero
from chainrisk.functions.windows import forward_fill, lagged, lead_by, rolling_product
from chainrisk.operators.decline import FLAG_COLUMNS

YEARLY = ["year"]
QUARTERLY = ["year", "quarter"]


def _dated(df: DataFrame, date: str, period: Sequence[str]) -> DataFrame:
    parts = {"year": F.year(date), "quarter": F.quarter(date)}
    return df.withColumns({p: parts[p] for p in period})


def _last_known(value: Column, order: str) -> Column:
    """Value of the latest row that has one."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


# -- links to securities -----------------------------------------------------


def _linked(df: DataFrame, links: DataFrame, x: Column, lo: Column, hi: Column) -> DataFrame:
    """Left join on firm with ``lo <= x <= hi``; a missing bound is open."""
    table = links.select(
        F.col("gvkey").alias("firm_gvkey"),
        F.col("lpermno").alias("firm_permno"),
        lo.alias("_lo"),
        hi.alias("_hi"),
    )
    inside = (
        (F.col("f.firm_gvkey") == F.col("l.firm_gvkey"))
        & ((x >= F.col("_lo")) | F.col("_lo").isNull())
        & ((x <= F.col("_hi")) | F.col("_hi").isNull())
    )
    return (
        df.alias("f")
        .join(table.alias("l"), inside, "left")
        .select("f.*", "l.firm_permno")
        .distinct()
    )


def link_permno_year(flags: DataFrame, links: DataFrame) -> DataFrame:
    return _linked(flags, links, F.col("f.year"), F.year("linkdt"), F.year("linkenddt"))


def link_permno_date(flags: DataFrame, quarterly: DataFrame, links: DataFrame) -> DataFrame:
    """Security valid at the fiscal date that falls into the quarter's last month."""
    dates = quarterly.select(
        F.col("gvkey").alias("firm_gvkey"),
        F.year("datadate").alias("year"),
        F.month("datadate").alias("month"),
        "datadate",
    )
    dated = (
        flags.withColumn("month", month_of_quarter("quarter"))
        .join(dates, ["firm_gvkey", "year", "month"], "left")
        .drop("month")
        .dropna("any")
    )
    return _linked(dated, links, F.col("f.datadate"), F.col("linkdt"), F.col("linkenddt"))


# -- controls from prices ----------------------------------------------------


def size(stock: DataFrame, period: Sequence[str] = QUARTERLY) -> DataFrame:
    """Last known market value of the period."""
    value = F.abs("prc") * F.col("shrout")
    return (
        _dated(stock, "date", period)
        .groupBy("permno", *period)
        .agg(_last_known(value, "date").alias("size"))
        .dropna("any")
    )


def past_return_year(stock: DataFrame) -> DataFrame:
    yearly = _dated(stock, "date", YEARLY).groupBy("permno", "year").agg(
        product_or_one(F.col("ret") + 1).alias("gross")
    )
    return yearly.select("permno", "year", lagged("gross", 1, ["permno"], YEARLY).alias("ret"))


def past_return_quarter(stock: DataFrame, quarters: int = 4) -> DataFrame:
    """Trailing product of the gross returns of four quarters of one security."""
    by_quarter = _dated(stock, "date", QUARTERLY).groupBy("permno", *QUARTERLY).agg(
        product_or_one(F.col("ret") + 1).alias("gross")
    )
    rolled = rolling_product("gross", quarters, ["permno"], QUARTERLY)
    return by_quarter.select("permno", *QUARTERLY, rolled.alias("ret")).dropna("any")


def past_price_year(stock: DataFrame) -> DataFrame:
    yearly = _dated(stock, "date", YEARLY).groupBy("permno", "year").agg(
        F.abs(_last_known(F.col("prc"), "date")).alias("prc")
    )
    return yearly.select(
        "permno", "year", lagged("prc", 2, ["permno"], YEARLY).alias("prc")
    ).dropna("any")


def past_price_quarter(stock: DataFrame) -> DataFrame:
    """Price on the last business day two quarters before the quarter's last row."""
    then = stock.select("permno", F.col("date").alias("then"), F.col("prc").alias("prc_then"))
    looked_up = (
        stock.select("permno", "date", business_day_two_quarters_back("date").alias("then"))
        .join(then, ["permno", "then"], "left")
    )
    return (
        _dated(looked_up, "date", QUARTERLY)
        .groupBy("permno", *QUARTERLY)
        .agg(F.abs(F.max_by("prc_then", "date")).alias("prc"))
        .dropna("any")
    )


def volume(stock: DataFrame, period: Sequence[str]) -> DataFrame:
    return _dated(stock, "date", period).groupBy("permno", *period).agg(
        sum_or_zero(F.col("vol").cast("double")).alias("vol")
    )


def past_volume_year(stock: DataFrame) -> DataFrame:
    lag = lagged("vol", 2, ["permno"], YEARLY)
    return volume(stock, YEARLY).select("permno", "year", lag.alias("vol")).dropna("any")


def past_volume_quarter(stock: DataFrame) -> DataFrame:
    """Volume of the calendar quarter two quarters back, NULL if there is none."""
    now = volume(stock, QUARTERLY).withColumn("t", quarter_index("year", "quarter"))
    then = now.select("permno", (F.col("t") + 2).alias("t"), F.col("vol").alias("vol_then"))
    return now.join(then, ["permno", "t"], "left").select(
        "permno", *QUARTERLY, F.col("vol_then").alias("vol")
    )


# -- controls from accounts --------------------------------------------------


def clean_annual(accounts: DataFrame) -> DataFrame:
    """Annual accounts without gaps; missing advertising counts as zero."""
    return accounts.fillna(0.0, ["xad"]).dropna("any")


def annual_ratios(accounts: DataFrame) -> DataFrame:
    """Investment, tangibility, return on assets and advertising per fiscal year."""
    tangible = F.col("che") + F.col("rect") + F.col("invt") + F.col("ppent")
    return clean_annual(accounts).select(
        "gvkey",
        "fyear",
        ratio("capx", "sale").alias("capx"),
        ratio(tangible, F.col("at")).alias("tant"),
        ratio("ni", "at").alias("roa"),
        F.col("xad").alias("adv_exp"),
    )


def quarterly_ratios(accounts: DataFrame) -> DataFrame:
    tangible = F.col("cheq") + F.col("rectq") + F.col("invtq") + F.col("ppentq")
    return _dated(accounts, "datadate", QUARTERLY).select(
        "gvkey",
        *QUARTERLY,
        ratio("capxy", "saleq").alias("capx"),
        ratio(tangible, F.col("atq")).alias("tant"),
        ratio("niq", "atq").alias("roa"),
    )


def advertising_quarter(quarterly: DataFrame, annual: DataFrame) -> DataFrame:
    """Annual advertising at its quarter, carried forward within the firm."""
    dates = _dated(quarterly.select("gvkey", "datadate"), "datadate", QUARTERLY)
    spent = _dated(annual.select("gvkey", "datadate", "xad").dropna("any"), "datadate", QUARTERLY)
    joined = dates.join(spent.drop("datadate"), ["gvkey", *QUARTERLY], "left")
    filled = forward_fill("xad", ["gvkey"], ["datadate", "xad"])
    return joined.select("gvkey", *QUARTERLY, filled.alias("adv_exp")).dropna("any")


def book_to_market_year(linked: DataFrame, annual: DataFrame, stock: DataFrame) -> DataFrame:
    """Book equity of the fiscal year over market value of the same year."""
    book = (
        linked.select("firm_gvkey", "firm_permno", "year")
        .distinct()
        .join(
            clean_annual(annual).select(
                F.col("gvkey").alias("firm_gvkey"), F.col("fyear").cast("int").alias("year"), "ceq"
            ),
            ["firm_gvkey", "year"],
        )
    )
    market = size(stock, YEARLY).withColumnRenamed("permno", "firm_permno")
    return (
        market.join(book, ["firm_permno", "year"])
        .select("firm_gvkey", "year", ratio("ceq", "size").alias("bm"))
        .dropna("any")
    )


def book_to_market_quarter(linked: DataFrame, quarterly: DataFrame, stock: DataFrame) -> DataFrame:
    """Book equity at the fiscal date over the calendar year's last market value."""
    equity = quarterly.select(
        F.col("gvkey").alias("firm_gvkey"),
        "datadate",
        forward_fill("ceqq", ["gvkey"], ["datadate"]).alias("ceqq"),
    )
    book = (
        linked.select("firm_gvkey", "firm_permno", "datadate")
        .distinct()
        .join(equity, ["firm_gvkey", "datadate"])
        .withColumn("year", F.year("datadate"))
    )
    market = (
        size(stock, QUARTERLY)
        .groupBy(F.col("permno").alias("firm_permno"), "year")
        .agg(F.max_by("size", "quarter").alias("market_value"))
    )
    return (
        book.join(market, ["firm_permno", "year"])
        .select(
            "firm_gvkey",
            "year",
            F.quarter("datadate").alias("quarter"),
            ratio("ceqq", "market_value").alias("bm"),
        )
        .dropna("any")
        .distinct()
    )


# -- returns -----------------------------------------------------------------


def compound_returns(portfolio: DataFrame, period: Sequence[str]) -> DataFrame:
    """Gross return of the security and of its portfolio (given in percent)."""
    return _dated(portfolio, "rdate", period).groupBy("permno", *period).agg(
        product_strict(F.col("ret") + 1).alias("ret"),
        product_strict(F.col("port_ret") / 100 + 1).alias("port_ret"),
    )


def _by_horizon(df: DataFrame, period: Sequence[str], values: dict[int, Column]) -> DataFrame:
    """One row per horizon that has a value; all horizons share one window pass."""
    offers = F.array(
        *[F.struct(F.lit(n).alias("horizon"), v.alias("excess_return")) for n, v in values.items()]
    )
    return (
        df.select("permno", *period, offers.alias("offers"))
        .select("permno", *period, F.explode("offers").alias("o"))
        .select("o.horizon", "permno", *period, "o.excess_return")
        .dropna("any")
    )


def excess_return_leads(
    portfolio: DataFrame, period: Sequence[str], horizons: Sequence[int]
) -> DataFrame:
    """Excess return so many rows later in the security's own order, per horizon."""
    excess = compound_returns(portfolio, period).withColumn(
        "excess", F.col("ret") - F.col("port_ret")
    )
    later = {n: lead_by("excess", n, ["permno"], list(period)) for n in horizons}
    return _by_horizon(excess, period, later)


def excess_return_cumulative(portfolio: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Excess of the gross returns compounded over the next quarters, per horizon."""

    def rolled(c: str, n: int) -> Column:
        return rolling_product(c, n, ["permno"], QUARTERLY, leading=True)

    ahead = {n: rolled("ret", n) - rolled("port_ret", n) for n in horizons}
    return _by_horizon(compound_returns(portfolio, QUARTERLY), QUARTERLY, ahead)


# -- regression sample -------------------------------------------------------


def _by_security(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("permno", "firm_permno")


def regression_sample_year(
    linked: DataFrame, stock: DataFrame, annual: DataFrame, excess: DataFrame
) -> DataFrame:
    """Flags, excess return and controls of a firm-year, complete rows only."""
    by_security = ["firm_permno", "year"]
    ratios = annual_ratios(annual).withColumns(
        {"firm_gvkey": F.col("gvkey"), "year": F.col("fyear").cast("int")}
    )
    sample = (
        linked.join(_by_security(excess), by_security)
        .join(_by_security(size(stock, YEARLY)), by_security)
        .join(_by_security(past_return_year(stock)), by_security)
        .join(_by_security(past_volume_year(stock)), by_security)
        .join(book_to_market_year(linked, annual, stock), ["firm_gvkey", "year"])
        .join(ratios.drop("gvkey", "fyear"), ["firm_gvkey", "year"])
    )
    return sample.distinct().dropna("any")


def regression_sample_quarter(
    linked: DataFrame, stock: DataFrame, quarterly: DataFrame, annual: DataFrame, excess: DataFrame
) -> DataFrame:
    """The same per quarter; advertising joins last and is zero if unknown."""
    by_security = ["firm_permno", *QUARTERLY]
    by_firm = ["firm_gvkey", *QUARTERLY]

    def firm(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("gvkey", "firm_gvkey")

    sample = (
        linked.join(_by_security(excess), by_security)
        .join(_by_security(size(stock, QUARTERLY)), by_security)
        .join(_by_security(past_return_quarter(stock)), by_security)
        .join(_by_security(past_volume_quarter(stock)), by_security)
        .join(book_to_market_quarter(linked, quarterly, stock), by_firm)
        .join(firm(quarterly_ratios(quarterly)), by_firm)
    )
    return (
        sample.distinct()
        .dropna("any")
        .join(firm(advertising_quarter(quarterly, annual)), by_firm, "left")
        .distinct()
        .fillna(0)
    )


def usable_rows(sample: DataFrame) -> DataFrame:
    """Rows on which the logarithms of the model exist."""
    positive = [F.col(c) > 0 for c in ("size", "bm", "ret", "vol")]
    cond = positive[0]
    for p in positive[1:]:
        cond = cond & p
    return sample.filter(cond)


def model_columns(sample: DataFrame) -> DataFrame:
    """Regressors of the model, logarithms taken."""
    logs = {f"log_{c}": F.log(c) for c in ("size", "bm", "ret", "vol")}
    return usable_rows(sample).withColumns(logs)


ALL_FLAGS = list(FLAG_COLUMNS.values())
FIRST_FLAGS = [n for (_, d), n in FLAG_COLUMNS.items() if d == 1]
CONTROLS = ["log_size", "log_bm", "log_ret", "log_vol", "capx", "tant", "roa", "adv_exp"]
