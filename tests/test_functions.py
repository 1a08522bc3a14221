"""Null, calendar, text and window rules on hand-made rows."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chainrisk.functions import calendar as C
from chainrisk.functions import text as X
from chainrisk.functions import values as V
from chainrisk.functions import windows as W
from chainrisk.sources import lexicons as LX
from chainrisk.sources import tables as TB


def test_nan_becomes_null_and_flags_stay_zero(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), 1.0), (2, 2.0, 1.0), (3, None, 1.0), (4, 1.0, None)],
        "i int, a double, b double",
    )
    out = V.nan_to_null(df).withColumn("f", V.larger_flag("a", "b"))
    assert rows(out, "i", "a", "f") == [(1, None, 0), (2, 2.0, 1), (3, None, 0), (4, 1.0, 0)]


def test_ratio_clip_sum_product(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.0), ("a", -2.0, 4.0), ("b", None, 1.0)], "k string, x double, y double"
    )
    assert rows(df.select(V.ratio("x", "y"))) == [(-0.5,), (None,), (None,)]
    assert rows(df.select(V.clip_negative("x"))) == [(0.0,), (1.0,), (None,)]
    agg = df.groupBy("k").agg(
        V.sum_or_zero("x").alias("s"),
        V.product_or_one("x").alias("p"),
        V.product_strict(F.col("x")).alias("q"),
    )
    assert rows(agg, "k", "s", "p", "q") == [("a", -1.0, -2.0, -2.0), ("b", 0.0, 1.0, None)]
    ids = spark.createDataFrame([("1004",), ("1004.0",), ("x",), (None,)], "v string")
    assert [r[0] for r in ids.select(V.as_id("v")).collect()] == [1004, 1004, None, None]


@pytest.mark.parametrize(
    "day, expected",
    [
        ("2020-08-31", "2020-03-31"),  # month end rolls back to February, quarter ends in March
        ("2020-09-30", "2020-03-31"),
        ("2021-06-30", "2020-12-31"),
        ("2020-07-01", "2020-03-31"),  # look-back falls on a quarter's first day
        ("2023-12-31", "2023-06-30"),
        ("2019-09-30", "2019-03-29"),  # 31 March 2019 is a Sunday
        ("2018-12-31", "2018-06-29"),  # 30 June 2018 is a Saturday
    ],
)
def test_business_day_two_quarters_back(spark, day, expected):
    df = spark.createDataFrame([(dt.date.fromisoformat(day),)], "d date")
    assert df.select(C.business_day_two_quarters_back("d")).first()[0] == dt.date.fromisoformat(expected)


def test_quarter_arithmetic(spark):
    df = spark.createDataFrame([(2021, 1), (2020, 4)], "year int, quarter int")
    back = C.quarter_index("year", "quarter") - 2
    out = df.select(
        C.quarter_end("year", "quarter"), C.year_of_index(back), C.quarter_of_index(back),
        C.period_label("year", "quarter"),
    )
    assert rows(out) == [
        (dt.date(2020, 12, 31), 2020, 2, "2020Q4"),
        (dt.date(2021, 3, 31), 2020, 3, "2021Q1"),
    ]


def test_cleaning_glues_and_bigrams(spark):
    df = spark.createDataFrame([("Beta-gamma\nDelta  É x1",), ("one",), ("",)], "t string")
    words = df.select(X.words_of("t").alias("w"))
    assert [r[0] for r in words.collect()] == [["betagammadelta", "x"], ["one"], []]
    assert [r[0] for r in words.select(X.bigrams_of("w")).collect()] == [["betagammadelta x"], [], []]


def test_base_name_strips_two_legal_forms(spark):
    names = ["ACME Co. Ltd.", "Acme, Inc", "Corp", "Acme Holdings LLC", "Inca", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(X.base_name("n")).collect()] == [
        "acme", "acme", "corp", "acme holdings", "inca", None,
    ]


def test_running_offsets_with_one_hot_key(spark):
    rng = random.Random(1)
    data = [("hot", i, rng.randint(0, 9)) for i in range(500)] + [("cold", 3, 5), ("cold", 9, 2)]
    df = spark.createDataFrame(data, "k string, o int, n int").repartition(7)
    got = {(r["k"], r["o"]): r["offset"] for r in W.running_offsets(df, ["k"], "o", "n", 16).collect()}
    total = 0
    for k, o, n in data[:500]:
        assert got[(k, o)] == total
        total += n
    assert got[("cold", 3)] == 0 and got[("cold", 9)] == 5


def test_rolling_products(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3, 4)], "k string, t int, x double")
    back = W.rolling_product("x", 3, ["k"], ["t"])
    ahead = W.rolling_product("x", 2, ["k"], ["t"], leading=True)
    assert rows(df.select("t", back, ahead)) == [
        (1, None, 2.0), (2, None, 6.0), (3, 6.0, 12.0), (4, 24.0, None),
    ]


def test_lexicons(spark):
    words = spark.createDataFrame(
        [("GOOD", 2009, 0), ("BAD", 0, 2009), ("BOTH", 1, 1), ("NONE", 0, 0)],
        "Word string, Positive int, Negative int",
    )
    assert rows(LX.sentiment_lexicon(words)) == [
        ("bad", "negative"), ("both", "negative"), ("both", "positive"), ("good", "positive"),
    ]
    lines = spark.createDataFrame([("risk Danger",), ("danger  risk",)], "value string")
    assert rows(LX.risk_lexicon(lines), "term") == [("Danger",), ("danger",), ("risk",)]
    table = spark.createDataFrame([("a_b", 0.5)], "bigram string, politicaltbb double")
    assert rows(LX.bigram_lexicon(table)) == [("a b", 0.5)]
    with pytest.raises(Exception, match="repeated bigram"):
        LX.bigram_lexicon(table.unionAll(table)).collect()
    assert {r[0] for r in rows(LX.covid_lexicon(spark), "term")} == {
        "coronavirus", "corona virus", "covid", "sarscov", "ncov",
    }


def test_csv_shards_and_nan(spark, tmp_path):
    for n in (1, 2):
        TB.write_csv(
            spark.createDataFrame([(n, float("nan")), (n + 10, 1.5)], "i int, x double"),
            str(tmp_path / f"shard{n}"),
        )
    df = TB.read_csv(
        spark, [str(tmp_path / "shard1"), str(tmp_path / "shard2")], "i int, x double"
    )
    assert rows(df) == [(1, None), (11, 1.5), (12, 1.5), (2, None)]


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = (
        TB.between_dates(orders, "o_orderdate", "1996-01-31", "1998-06-30")
        .select("o_orderkey")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan
