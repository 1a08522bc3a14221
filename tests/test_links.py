"""Panel routing, scores, degrees and declines on hand-made rows."""

import datetime as dt
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chainrisk.operators import decline as DC
from chainrisk.operators import degrees as DG
from chainrisk.operators import panel as P
from chainrisk.operators import scores as S
from chainrisk.sources.staging import staged

RELATION = (
    "source_company_id int, target_company_id int, rel_type string, start_ string, end_ string, "
    "SOURCE_name string, TARGET_name string, SOURCE_cusip string, TARGET_cusip string, "
    "SOURCE_isin string, TARGET_isin string"
)


def relation(start, end, **ids):
    names = ["SOURCE_name", "TARGET_name", "SOURCE_cusip", "TARGET_cusip", "SOURCE_isin", "TARGET_isin"]
    return (1, 2, "SUPPLIER", start, end, *[ids.get(n) for n in names])


def test_panel_rows_lie_inside_the_relation(spark):
    data = [
        relation("2003-03-31 00:00:00", "2003-06-30 00:00:00"),  # both ends on a quarter end
        relation("2003-04-01 00:00:00", "2003-06-29 00:00:00"),  # no quarter end inside
        relation("2001-01-01 00:00:00", "2003-01-31 00:00:00"),  # before the study
        relation("2023-08-15 00:00:00", "4000-01-01 00:00:00"),  # still open
    ]
    df = spark.createDataFrame(data, RELATION)
    got = rows(P.panel_expand(df, 2003, 2023, "2023-12-31"), "date")
    assert got == [
        (dt.date(2003, 3, 31),), (dt.date(2003, 6, 30),), (dt.date(2023, 9, 30),), (dt.date(2023, 12, 31),),
    ]


def test_each_row_takes_exactly_one_route(spark):
    kinds = ["cusip", "isin", "name"]
    data = []
    for mask in range(64):
        ids = {f"{s}_{k}": "x" for b, (s, k) in enumerate((s, k) for s in ("SOURCE", "TARGET") for k in kinds) if mask >> b & 1}
        data.append(relation("2003-01-01", "2003-12-31", **ids))
    df = spark.createDataFrame(data, RELATION)
    parts = {k: P.routed(df, k).count() for k in ("cusip", "isin", "name", "none")}
    assert sum(parts.values()) == 64
    assert parts["cusip"] == 16 and parts["isin"] == 12 and parts["name"] == 9


def test_identifier_filter_allows_missing_names(spark):
    df = spark.createDataFrame(
        [
            relation("2003-01-01", "2003-12-31", SOURCE_isin="a", TARGET_cusip="123456789"),
            relation("2003-01-01", "2003-12-31", SOURCE_isin="a"),
        ],
        RELATION,
    )
    kept = P.with_any_identifier(P.panel_expand(df, 2003, 2003, "2003-12-31"))
    assert rows(kept, "quarter", "TARGET_cusip", "TARGET_name") == [(q, "12345678", None) for q in (1, 2, 3, 4)]


def test_zero_sales_have_no_share(spark):
    sales = spark.createDataFrame(
        [(1, 2, 2010, -5.0), (1, 3, 2010, 0.0), (4, 3, 2010, 10.0), (None, 3, 2010, 7.0)],
        "GVKEY1 int, GVKEY2 int, y int, SALECS double",
    )
    totals = {(r["side"], r["firm_gvkey"]): r["sale_t"] for r in S.sales_totals(sales).collect()}
    assert totals == {
        ("customer", 1): 0.0, ("customer", 4): 10.0, ("supplier", 2): 0.0, ("supplier", 3): 17.0,
    }
    links = S.disclosed_links(sales)
    assert links.count() == 3 * 2 * 4
    scored = links.select("*", *[F.lit(2.0).alias(f"{r}_{m}") for r in ("firm", "partner") for m in S.METRICS])
    shares = rows(
        S.value_weighted_links(scored, S.sales_totals(sales)).filter("side = 'customer' AND quarter = 1"),
        "firm_gvkey", "partner_gvkey", "sale_r",
    )
    assert shares == [(1, 2, None), (1, 3, None), (4, 3, 1.0)]


def plain_degree3(links, first):
    out = {}
    for f, p in links:
        out.setdefault(f, [])
        for g, q in links:
            if g == p and q in first:
                out[f].append(first[q])
    return {f: (sum(v) / len(v) if v else None) for f, v in out.items()}


def test_third_degree_counts_paths(spark):
    rng = random.Random(2)
    links = sorted({(rng.randint(1, 12), rng.randint(1, 12)) for _ in range(40)})
    score = {p: float(rng.randint(0, 50)) for p in range(1, 13)}
    data = [("supplier", f, p, 2010, 1, *[1.0] * 3, *[score[p]] * 3) for f, p in links]
    schema = "side string, firm_gvkey int, partner_gvkey int, year int, quarter int, " + ", ".join(
        f"{r}_{m} double" for r in ("firm", "partner") for m in S.METRICS
    )
    df = spark.createDataFrame(data, schema).repartition(5)
    first = DG.first_degree_equal(df)
    plain = {r["firm_gvkey"]: r["pol"] for r in first.collect()}
    want = plain_degree3(links, plain)
    got = {r["firm_gvkey"]: r["pol"] for r in DG.third_degree_equal(df, first).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None)
        if v is not None:
            assert abs(got[k] - v) < 1e-9


def test_hop_links_and_cycles(spark):
    links = spark.createDataFrame(
        [("supplier", 1, 2), ("supplier", 2, 3), ("supplier", 3, 1), ("customer", 9, 1)],
        "side string, firm_gvkey int, partner_gvkey int",
    ).selectExpr("*", "2010 AS year", "1 AS quarter")
    hops = DG.degree_links(links)
    assert rows(hops.filter("degree = 3"), "firm_gvkey", "partner_gvkey") == [(1, 1), (2, 2), (3, 3)]
    assert DG.link_cycles(hops).count() == 3
    means = {(r["side"], r["degree"]): r["avg_partners"] for r in DG.mean_partner_count(hops).collect()}
    assert means == {
        ("supplier", 1): 0.75, ("supplier", 2): 0.75, ("supplier", 3): 0.75,
        ("customer", 1): 0.25, ("customer", 2): 0.0, ("customer", 3): 0.0,
    }


def plain_hops(links):
    """Pairs at one, two and three hops by plain set walks."""
    out, reached = {}, {k: set(v) for k, v in links.items()}
    for degree in (1, 2, 3):
        out |= {(degree, f, p): 1 for f, ps in reached.items() for p in ps}
        reached = {f: {q for p in ps for q in links.get(p, ())} for f, ps in reached.items()}
    return sorted(out)


@pytest.mark.parametrize("hub_links", [1, 7, 4096])
def test_hop_links_like_set_walks(spark, hub_links):
    rng = random.Random(9)
    plain, data = {}, []
    for side in ("supplier", "customer"):
        for quarter in (1, 2):
            pairs = {(rng.randint(1, 150), rng.randint(1, 150)) for _ in range(300)}
            plain[side, quarter] = {f: {q for g, q in pairs if g == f} for f, _ in pairs}
            data += [(side, f, p, 2010, quarter) for f, p in pairs]
    links = spark.createDataFrame(data + data[:50], "side string, firm_gvkey int, partner_gvkey int, year int, quarter int")
    got = DG.degree_links(links.repartition(3), hub_links)
    for (side, quarter), own in plain.items():
        here = got.filter((F.col("side") == side) & (F.col("quarter") == quarter))
        assert sorted(tuple(r) for r in here.select("degree", "firm_gvkey", "partner_gvkey").collect()) == plain_hops(own)


@pytest.mark.parametrize("hub_links", [1, 4096])
def test_cycles_are_found_without_a_third_hop(spark, hub_links):
    rng = random.Random(11)
    data = []
    for side in ("supplier", "customer"):
        for quarter in (1, 2):
            data += [(side, rng.randint(1, 150), rng.randint(1, 150), 2010, quarter) for _ in range(400)]
    data += [("supplier", 7, 7, 2010, 1), ("supplier", None, 3, 2010, 1), ("supplier", 3, None, 2010, 1)]
    links = spark.createDataFrame(data, "side string, firm_gvkey int, partner_gvkey int, year int, quarter int")
    want = rows(DG.link_cycles(DG.degree_links(links)))
    before = set(staged(spark))
    got = rows(DG.cycle_links(DG.reach(links.repartition(3), hub_links)))
    assert got == want and {r[-1] for r in got} == {1, 2, 3}
    assert not [path for path in staged(spark) if path not in before and "degree-3" in path]


def test_hop_links_of_a_hub(spark):
    n = 10_000
    wide = spark.range(1, n + 1).selectExpr("CAST(id AS INT) + 10 AS x")
    side = lambda s, f, p: wide.selectExpr(f"'{s}' AS side", f"{f} AS firm_gvkey", f"{p} AS partner_gvkey")
    few = spark.createDataFrame(
        [("in", 0, k) for k in (1, 2, 3)] + [("out", k, 0) for k in (1, 2, 3)] + [("out", 4, 1)],
        "side string, firm_gvkey int, partner_gvkey int",
    )
    links = side("in", "x", 0).unionByName(side("out", 0, "x")).unionByName(few).selectExpr("*", "2010 AS year", "1 AS quarter")
    before = set(staged(spark))
    hops = DG.degree_links(links)
    count = {(r["side"], r["degree"]): r["count"] for r in hops.groupBy("side", "degree").count().collect()}
    assert count == {
        ("in", 1): n + 3, ("out", 1): n + 4, ("in", 2): 3 * n, ("out", 2): 3 * n + 1, ("out", 3): n,
    }
    assert hops.distinct().count() == sum(count.values())
    written = [spark.read.parquet(path).count() for path in staged(spark) if path not in before]
    assert max(written) <= 6 * n + 1  # no more than the distinct pairs of one hop


def plain_quarterly(links, scores):
    """Row-wise fills in order of quarter and score."""
    out, by = [], {}
    for f, p, t in links:
        by.setdefault((f, p), set()).add(t)
    for (f, p), times in by.items():
        own = last = None
        step = []
        for t in sorted(times):
            for v in sorted(scores.get((p, t), ())) or [None]:
                own = own if v is None else v
                step.append((t, own))
        final = []
        for t, v in sorted(set(step), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            for w in sorted(scores.get((p, t - 4), ())) or [None]:
                final.append((t, v, w))
        for t, v, w in sorted(final, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] is not None, x[2] or 0)):
            last = last if w is None else w
            if v is not None and last is not None:
                out.append((f, p, t, v, last, int(v < last)))
    return sorted(out)


def test_quarterly_decline_with_repeated_scores(spark):
    rng = random.Random(4)
    scores = {}
    for _ in range(60):
        scores.setdefault((rng.randint(1, 4), rng.randint(0, 15)), set()).add(float(rng.randint(1, 9)))
    links = sorted({(f, rng.randint(1, 4), rng.randint(4, 15)) for f in range(6) for _ in range(12)})
    link_df = spark.createDataFrame(
        [("supplier", 1, f, p, 2000 + t // 4, t % 4 + 1) for f, p, t in links],
        "side string, degree int, firm_gvkey int, partner_gvkey int, year int, quarter int",
    )
    flat = [(p, 2000 + t // 4, t % 4 + 1, v) for (p, t), vs in scores.items() for v in vs]
    score_df = spark.createDataFrame(flat + flat[:5], "gvkey int, year int, quarter int, scorevalue double")
    got = rows(
        DC.quarterly_decline(link_df, score_df).selectExpr(
            "firm_gvkey", "partner_gvkey", "(year - 2000) * 4 + quarter - 1 AS t", "scorevalue", "lst_score", "decline"
        )
    )
    assert sorted(got) == plain_quarterly(links, scores)
    rates = DC.firm_decline_rate(DC.quarterly_decline(link_df, score_df))
    assert rates.filter("decline_rate < 0 OR decline_rate > 1").count() == 0


def _random_declines(spark):
    rng = random.Random(12)
    scores = [(rng.randint(1, 4), rng.randint(2000, 2005), rng.randint(1, 4), float(rng.randint(1, 9))) for _ in range(40)]
    links = [("supplier", 1, f, rng.randint(1, 5), rng.randint(1999, 2005), rng.randint(1, 4)) for f in range(6) for _ in range(15)]
    return (
        sorted(set(links)),
        spark.createDataFrame(links + links[:20], "side string, degree int, firm_gvkey int, partner_gvkey int, year int, quarter int"),
        spark.createDataFrame(scores, "gvkey int, year int, quarter int, scorevalue double"),
        scores,
    )


def test_annual_decline_with_repeated_links_and_scores(spark):
    links, link_df, score_df, scores = _random_declines(spark)
    by = {}
    for p, year, _, v in scores:
        by.setdefault((p, year), set()).add(v)
    want = []
    for f, p in sorted({r[2:4] for r in links}):
        last = None
        for year in sorted({r[4] for r in links if r[2:4] == (f, p)}):
            for v in sorted(by.get((p, year), ())) or [last]:
                if v is not None and last is not None:
                    want.append((f, p, year, v, last, int(v < last)))
                last = v
    got = DC.annual_decline(link_df, score_df.withColumnRenamed("year", "assessmentyear"))
    assert rows(got, "firm_gvkey", "partner_gvkey", "year", "scorevalue", "lst_score", "decline") == sorted(want)


def test_declines_move_links_once(spark):
    links, link_df, score_df, _ = _random_declines(spark)
    annual = score_df.withColumnRenamed("year", "assessmentyear")
    for found in (DC.quarterly_decline(link_df, score_df), DC.annual_decline(link_df, annual)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "firm_gvkey" not in "".join(re.findall(r"hashpartitioning\(.*?\)", plan))
        assert plan.count("Window") <= 2 and found.count() > 0


def test_summary_of_one_firm_quarter_has_no_deviation(spark):
    df = spark.createDataFrame(
        [("supplier", 1, 7, 8, 2010, 1, 1), ("supplier", 1, 7, 9, 2010, 1, 0)],
        "side string, degree int, firm_gvkey int, partner_gvkey int, year int, quarter int, decline int",
    )
    got = rows(DC.decline_rate_summary(df))
    assert got == [("supplier", 1, 0.5, None, 0.5, 0.5, 0.5)]
    assert rows(DC.firm_decline_flag(df), "flag") == [(0,)]


def test_merged_ranges_expand_like_distinct_quarters(spark):
    from chainrisk.operators.panel import merged_ranges

    ranges = [("a", None, 1, 4), ("a", None, 2, 3), ("a", None, 5, 6), ("a", None, 9, 9), ("a", "x", 3, 8), ("b", None, 4, 4), ("b", None, 4, 4)]
    merged = merged_ranges(spark.createDataFrame(ranges, "pair string, id string, _first int, _last int"))
    got = [(r.pair, r.id, q) for r in merged.collect() for q in range(r._first, r._last + 1)]
    assert len(got) == len(set(got)) and set(got) == {(p, i, q) for p, i, lo, hi in ranges for q in range(lo, hi + 1)}
    assert merged.count() == 4


def _sales_and_scores(spark):
    rng = random.Random(7)
    sales = [(rng.randint(1, 9), rng.randint(1, 9), rng.randint(2009, 2011), float(rng.randint(-3, 9))) for _ in range(120)]
    sales += [(None, 2, 2010, 1.0), (3, None, 2010, 2.0), (4, 5, None, 2.0), (4, 5, 2010, None), (8, 8, 2010, 3.0)]
    score = lambda: rng.choice([None, 0.0, 1.5, 2.5])
    panel = [(g, y, q, score(), score(), score()) for g in range(1, 8) for y in (2009, 2010, 2011) for q in (1, 2, 4)]
    return (
        spark.createDataFrame(sales, "GVKEY1 bigint, GVKEY2 bigint, y int, SALECS double"),
        spark.createDataFrame(panel, "gvkey bigint, year int, quarter int, pol double, covid double, cc double"),
    )


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_annual_sales_spread_to_the_quarterly_links(spark):
    sales, panel = _sales_and_scores(spark)
    totals = S.sales_totals(sales)
    long = S.value_weighted_links(S.attach_scores(S.disclosed_links(sales), panel, 2010), totals)
    annual = S.scored_sales(sales, S.firm_years(panel, totals), 2010)
    got = S.quarterly_links(annual)
    assert rows(got, *sorted(long.columns)) == rows(long, *sorted(long.columns))
    # One row a sale is shuffled; eight links a sale are not.
    assert annual.count() * 8 == got.count()
    assert _shuffles(got) == 2 * _shuffles(annual)


def test_firm_meta_does_not_shuffle_its_combinations(spark):
    sales, panel = _sales_and_scores(spark)
    totals = S.sales_totals(sales)
    links = S.quarterly_links(S.scored_sales(sales, S.firm_years(panel, totals), 2010))
    meta = S.firm_meta(links)
    assert meta.count() == meta.distinct().count() > 0
    plan = meta._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_panel_merges_quarters_of_a_long_study_without_a_sort(spark):
    rng = random.Random(3)
    day = lambda: dt.date(1990, 1, 1) + dt.timedelta(days=rng.randint(0, 40 * 365))
    spans = [sorted((day(), day())) for _ in range(25)]
    data = [relation(str(a), str(b), SOURCE_cusip=rng.choice(["x", None])) for a, b in spans]
    panel = P.panel_expand(spark.createDataFrame(data, RELATION), 1992, 2027, "2027-12-31")
    ends = [C.date() for y in range(1992, 2028) for C in (dt.datetime(y, 3, 31), dt.datetime(y, 6, 30), dt.datetime(y, 9, 30), dt.datetime(y, 12, 31))]
    want = {(e, r[7]) for r, (a, b) in zip(data, spans) for e in ends if a <= e <= b}
    got = rows(panel, "date", "SOURCE_cusip")
    assert len(got) == len(want) and set(got) == want
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan


def test_distinct_sales_are_dealt_once_for_the_first_join(spark):
    data = [(s, b, 2010, float(s + b)) for s in range(1, 6) for b in range(1, 6) if s != b]
    sales = spark.createDataFrame(data + data[:4], "GVKEY1 int, GVKEY2 int, y int, SALECS double")
    panel = spark.createDataFrame([(f, 2010, q, 1.0, 2.0, 3.0) for f in range(1, 6) for q in (1, 2)], "gvkey int, year int, quarter int, pol double, covid double, cc double")
    firms = S.firm_years(panel, S.sales_totals(sales))
    scored = S.scored_sales(sales, firms, 2009)
    assert scored.count() == len(data)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(GVKEY1#" in plan
    assert not re.search(r"hashpartitioning\(GVKEY1#\d+L?, GVKEY2#", plan)


def test_names_are_reduced_before_quarters_are_spread(spark):
    rows = [
        (1, 2, "SUPPLIER", "1996-01-15", "1997-02-01", "Acme Inc.", "Zeta Corp.", "123456789", None, None, "US2"),
        (1, 2, "SUPPLIER", "1996-05-15", "4000-01-01", "ACME", "Zeta", "123456789", None, None, "US2"),
        (3, 4, "CUSTOMER", "1996-01-15", "1998-02-01", None, "Omega Ltd.", None, None, None, "US4"),
    ]
    ids = [f"{side}_{kind} string" for kind in ("name", "cusip", "isin") for side in ("SOURCE", "TARGET")]
    schema = ", ".join(["source_company_id long, target_company_id long, rel_type string, start_ string, end_ string", *ids])
    relations = spark.createDataFrame(rows, schema)
    study = (1995, 2001, "2001-12-31")
    want = P.with_any_identifier(P.panel_expand(relations, *study))
    got = P.identified_panel(relations, *study)
    sort = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert got.columns == want.columns and sort(got) == sort(want) and len(sort(got)) > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("regexp_replace") > plan.rindex("Generate")
    assert "regexp_replace" not in plan[: plan.rindex("Generate")]
