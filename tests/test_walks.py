"""Walks over packed links: searches, hops and declines that neither stage nor shuffle pairs."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_graph import plain

from chainrisk.operators import decline as DC
from chainrisk.operators import degrees as DG
from chainrisk.operators import graph as G
from chainrisk.operators import histories as H
from chainrisk.operators import walks as W
from chainrisk.operators.histories import Declines
from chainrisk.sources.staging import staged


def test_numbers_survive_packing():
    rng = np.random.default_rng(3)
    for top in (1, 200, 60_000, 1 << 40):
        values = np.sort(rng.integers(0, top, 500))
        assert (W.unpacked(W.packed(values)) == values).all()
    assert len(W.unpacked(W.packed(np.array([], np.int64)))) == 0


@pytest.mark.parametrize("at_once", [1, 9, 4096])
@pytest.mark.parametrize("starts", [1, 70])
def test_merged_rows_of_hubs_and_few_starts(at_once, starts):
    rng = np.random.default_rng(5)
    n = 900
    hub = np.array([v * n + u for v in (3, 899) for u in range(n) if u != v])  # more links than rounds
    keys = np.unique(np.concatenate([hub, rng.integers(0, n * n, 2500)]))
    assert W.ROUNDS < n
    for back in (False, True):
        step = W.Steps([W.Row(0, W.LINKS, None, 2000, 1, 0, W.packed(keys), None)], n, at_once, back)
        target, source = np.divmod(keys, n)
        if back:
            target, source = source, target
        linked = np.zeros((n, n), np.int64)
        linked[target, source] = 1
        few = np.zeros((len(step.nodes), starts))
        few[rng.integers(0, len(step.nodes), starts), np.arange(starts)] = 1.0
        for values in (few, rng.integers(1, 9, few.shape).astype(float)):
            want = linked[np.ix_(step.nodes, step.nodes)] @ values
            assert (step.merged(values, np.add) == want).all()


def test_searches_stage_sums_and_no_pairs(spark):
    rng = random.Random(6)
    pairs = {(2000, q): sorted({(rng.randint(1, 90), rng.randint(1, 90)) for _ in range(260)}) for q in (1, 2)}
    edges = spark.createDataFrame(
        [(y, q, a, b) for (y, q), es in pairs.items() for a, b in es], "year int, quarter int, source int, target int"
    )
    before = set(staged(spark))
    table = {(r["year"], r["quarter"], r["node"]): r for r in G.centrality_table(edges).collect()}
    for (y, q), es in pairs.items():
        for v, (_, between, close) in plain(es).items():
            assert table[y, q, v]["betweenness_centrality"] == pytest.approx(between)
            assert table[y, q, v]["closeness_centrality"] == pytest.approx(close)
    written = [spark.read.parquet(path).count() for path in staged(spark) if path not in before]
    assert max(written) <= len(table)  # a row per node and quarter; searches by rounds wrote one per block of starts


def test_search_of_no_edges(spark):
    none = spark.createDataFrame([], "year int, quarter int, source int, target int")
    assert rows(G.centrality_table(none)) == []
    loop = spark.createDataFrame([(2000, 1, 4, 4)], "year int, quarter int, source int, target int")
    assert rows(G.centrality_table(loop), "node", "degree_centrality", "betweenness_centrality", "closeness_centrality") == [(4, 1.0, 0.0, 0.0)]
    assert G.betweenness_centrality(G.search_all(loop)).filter(F.col("betweenness_centrality") != 0).count() == 0


def _links_and_scores(spark, nulls=True):
    rng = random.Random(21)
    links = [
        (rng.choice(["supplier", "customer"]), rng.randint(1, 90), rng.randint(1, 90), rng.randint(1999, 2003), rng.randint(1, 4))
        for _ in range(5500)
    ]
    links += links[:30]
    if nulls:
        links += [("supplier", None, 5, 2001, q) for q in (1, 3)] + [("supplier", 6, None, 2001, 1), (None, 6, 5, 2001, 2)]
        links += [("customer", 7, 5, None, 1), ("customer", 8, 5, 2002, None), ("customer", 8, 5, 2003, 1), (None, 9, 5, 2001, 3)]
    # Firms without any score, with gaps, with several scores of a quarter, and one that is not a number.
    scores = [(rng.randint(1, 80), rng.randint(1998, 2003), rng.randint(1, 4), float(rng.randint(1, 9))) for _ in range(700)]
    scores += [(5, y, q, float(y % 7 + q)) for y in range(1999, 2004) for q in (1, 2)] + scores[:20] + [(11, 2001, 2, None), (12, 2001, 2, float("nan"))]
    return (
        spark.createDataFrame(links, "side string, firm_gvkey int, partner_gvkey int, year int, quarter int").repartition(3),
        spark.createDataFrame(scores, "gvkey int, year int, quarter int, scorevalue double"),
    )


def test_declines_of_packed_links_equal_those_of_listed_links(spark):
    links, scores = _links_and_scores(spark)
    before = set(staged(spark))
    walked = DG.walks(links, 50)
    listed = DG.listed_links(walked).cache()
    assert listed.count() == listed.distinct().count() > 20_000
    written = [spark.read.parquet(path).count() for path in staged(spark) if path not in before]
    assert max(written) <= links.count()  # pairs of two and three hops are not staged
    # Prepared scores hold no NaN; annual rows with one would be dropped, quarterly ones are not.
    year = scores.withColumnRenamed("year", "assessmentyear").drop("quarter").filter("NOT isnan(scorevalue)")
    for make, own in ((DC.quarterly_decline, scores), (DC.annual_decline, year)):
        want, got = make(listed, own), make(walked, own)
        assert isinstance(got, Declines)
        columns = want.columns
        assert str(rows(DC.listed_declines(got), *columns)) == str(rows(want, *columns))
        for of in (DC.firm_decline_rate, DC.firm_decline_flag, DC.flagged_share, DC.decline_coverage, DC.with_decline_rate):
            assert str(rows(of(got), *of(want).columns)) == str(rows(of(want))), of
    assert rows(DG.mean_partner_count(walked)) == rows(DG.mean_partner_count(listed))
    summary, want = (rows(DC.decline_rate_summary(DC.quarterly_decline(x, scores))) for x in (walked, listed))
    for x, y in zip(summary, want):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])


def test_few_starts_and_rows_at_a_time_change_nothing(spark):
    links, scores = _links_and_scores(spark, nulls=False)
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 1 << 62, (700, 3)).astype("<u8")
    want = {(s, p) for p in range(700) for s in range(192) if int(bits[p, s >> 6]) >> (s & 63) & 1}
    found = [(s.copy(), p) for s, p in W.pairs(bits)]
    assert sum(map(len, (s for s, _ in found))) == len(want) and {(a, b) for s, p in found for a, b in zip(s.tolist(), p.tolist())} == want
    assert all((np.diff(s) >= 0).all() for s, _ in found)
    sizes = np.array([5, 1 << 20, 3, 4, 1 << 18, 1 << 18, 1 << 18])
    cut = list(H._cut(sizes))
    assert [i for c in cut for i in range(c.start, c.stop)] == list(range(7)) and len(cut) > 2
    names = links.select("side", *[F.concat(F.lit("f"), c).alias(c) for c in ("firm_gvkey", "partner_gvkey")], "year", "quarter")
    as_text = DG.listed_links(DG.walks(names, 4096))
    assert as_text.count() == DG.listed_links(DG.walks(links, 4096)).count()


def test_walks_of_no_links(spark):
    none = spark.createDataFrame([], "side string, firm_gvkey int, partner_gvkey int, year int, quarter int")
    scores = spark.createDataFrame([(1, 2000, 1, 3.0)], "gvkey int, year int, quarter int, scorevalue double")
    walked = DG.walks(none, 4096)
    assert DG.listed_links(walked).count() == 0
    declines = DC.quarterly_decline(walked, scores)
    assert DC.firm_decline_rate(declines).count() == DC.listed_declines(declines).count() == DC.decline_coverage(declines).count() == 0
