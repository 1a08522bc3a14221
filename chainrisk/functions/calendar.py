"""Calendar expressions: quarters, quarter ends, look-back days.

Quarters are counted as one integer, ``year * 4 + quarter - 1``, so that lags,
ranges and look-backs are integer arithmetic with no month-end drift.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quarter_index(year: Column | str, quarter: Column | str) -> Column:
    return (_c(year) * 4 + _c(quarter) - 1).cast("int")


def index_of_date(date: Column | str) -> Column:
    return quarter_index(F.year(_c(date)), F.quarter(_c(date)))


def year_of_index(index: Column | str) -> Column:
    return F.floor(_c(index) / 4).cast("int")


def quarter_of_index(index: Column | str) -> Column:
    return (F.pmod(_c(index), F.lit(4)) + 1).cast("int")


def quarter_end(year: Column | str, quarter: Column | str) -> Column:
    return F.last_day(F.make_date(_c(year), _c(quarter) * 3, F.lit(1)))


def quarter_of_month(month: Column | str) -> Column:
    m = _c(month)
    return (
        F.when(m.between(1, 3), 1)
        .when(m.between(4, 6), 2)
        .when(m.between(7, 9), 3)
        .when(m.between(10, 12), 4)
    )


def month_of_quarter(quarter: Column | str) -> Column:
    return (_c(quarter) * 3).cast("int")


def period_label(year: Column | str, quarter: Column | str) -> Column:
    """``2021Q4`` style label."""
    return F.concat(_c(year).cast("string"), F.lit("Q"), _c(quarter).cast("string"))


def date_label(year: Column | str, quarter: Column | str) -> Column:
    """``2021-12-31`` style text of the quarter's last day."""
    return F.date_format(quarter_end(year, quarter), "yyyy-MM-dd")


def preceding_business_day(date: Column | str) -> Column:
    """The day itself, or the Friday before when it is a weekend."""
    d = _c(date)
    weekday = F.dayofweek(d)
    return F.date_sub(d, F.when(weekday == 1, 2).when(weekday == 7, 1).otherwise(0))


def business_day_two_quarters_back(date: Column | str) -> Column:
    """Last business day of the quarter that lies six months before ``date``."""
    six_back = F.add_months(_c(date), -6)
    last = F.date_sub(F.add_months(F.trunc(six_back, "quarter"), 3), 1)
    return preceding_business_day(last)
