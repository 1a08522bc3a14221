"""Supplier-customer combinations of annual sales against those of quarterly links."""

import pytest
from conftest import rows
from test_links import _sales_and_scores

from chainrisk.operators import combinations as CB
from chainrisk.operators import scores as S


@pytest.mark.parametrize("few", [False, True])
def test_combinations_of_annual_sales_move_no_quarterly_link(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(CB, "ENTRIES_AT_ONCE", 3)
        monkeypatch.setattr(CB, "SALES_PACKED", 10)
    sales, panel = _sales_and_scores(spark)
    # A firm that only sells, one that only buys, one whose sales are zero and one without scores.
    sales = sales.unionAll(spark.createDataFrame([(20, 1, 2010, 5.0), (1, 21, 2010, 5.0), (22, 1, 2010, 0.0), (23, 20, 2010, 4.0)], sales.schema))
    panel = panel.unionAll(spark.createDataFrame([(f, 2010, q, 1.0, 0.5, 2.0) for f in (20, 21, 22) for q in (1, 4)], panel.schema))
    firms = S.firm_years(panel, S.sales_totals(sales))
    scored = S.scored_sales(sales, firms, 2010)
    want = S.firm_meta(S.quarterly_links(scored))
    got = S.firm_meta(S.AnnualSales(scored, firms))
    columns = ["firm_gvkey", "year", "quarter", "supplier_gvkey", "customer_gvkey", "sc_pol", "sc_covid", "sc_cc"]
    assert rows(got, *columns) == rows(want, *columns) and want.count() > 200
    assert {True, False} == {r.customer_gvkey is None for r in got.collect()}
    packed = CB._packed_sales(scored, 3)
    # Rows that are shuffled: one per part, side, year and reading task in place of a row a link.
    assert few or packed.count() < scored.count()


def test_combinations_of_no_sales(spark):
    sales, panel = _sales_and_scores(spark)
    firms = S.firm_years(panel, S.sales_totals(sales))
    assert S.firm_meta(S.AnnualSales(S.scored_sales(sales, firms, 2050), firms)).count() == 0
