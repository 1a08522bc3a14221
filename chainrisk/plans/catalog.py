"""Every analytic of the library on the tables of one data directory.

A query returns the columns named in its spec, with types fixed:
``l`` bigint, ``d`` double rounded to six places, ``s`` string, ``t`` date.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainrisk.functions import calendar as C
from chainrisk.functions.text import base_name, words_of
from chainrisk.functions.values import ratio
from chainrisk.functions.windows import forward_fill, lead_by
from chainrisk.operators import decline as DC
from chainrisk.operators import degrees as DG
from chainrisk.operators import graph as G
from chainrisk.operators import market as M
from chainrisk.operators import names as N
from chainrisk.operators import panel as P
from chainrisk.operators import regression as R
from chainrisk.operators import scores as S
from chainrisk.operators import transcripts as T
from chainrisk.plans import inputs as IN
from chainrisk.plans.inputs import Inputs
from chainrisk.sources import lexicons as LX
from chainrisk.sources import tables as TB
from chainrisk.sources.staging import discard, stage, staging_root, table_versions

Builder = Callable[[Inputs], DataFrame]
QUERIES: dict[str, tuple[str, Builder]] = {}
_STAGED: dict[tuple, object] = {}


def query(spec: str, name: str | None = None) -> Callable[[Builder], Builder]:
    def register(fn: Builder) -> Builder:
        QUERIES[name or fn.__name__] = (spec, fn)
        return fn

    return register


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """Select the spec's columns with its types; doubles to six places.

    The small shift keeps exact ties such as 0.0000005 from rounding either way.
    """
    kinds = {"l": "bigint", "d": "double", "s": "string", "t": "date"}
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        col = F.col(name).cast(kinds[kind])
        if kind == "d":
            col = F.round(col + F.lit(1e-9), 6) + F.lit(0.0)
        out.append(col.alias(name))
    return df.select(*out)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    spec, build = QUERIES[name]
    return shaped(build(Inputs(spark, folder)), spec)


def shared(i: Inputs, name: str, build: Callable[[], object]):
    """Staged result used by several queries of one session, as long as the folder's files stay the same."""
    key = (i.spark.sparkContext.applicationId, i.folder, table_versions(i.spark, i.folder), name)
    if key not in _STAGED:
        _STAGED[key] = build()
    return _STAGED[key]


def forget(spark: SparkSession) -> None:
    """End the life of all staged results of the session and delete their files."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _STAGED if k[0] == app]:
        del _STAGED[key]
    discard(spark)


# -- intermediate results ----------------------------------------------------


def _links(i: Inputs) -> DataFrame:
    return P.sided_links(P.known_links(*_routes(i)))


def _panel_scores(i: Inputs) -> DataFrame:
    return S.score_panel(i["fx_pol"], i["fx_cc"])


def _scored(i: Inputs) -> DataFrame:
    return shared(
        i,
        "scored",
        lambda: stage(S.attach_scores(_links(i), _panel_scores(i), IN.MIN_YEAR), "scored-links"),
    )


def _weighted_sales(i: Inputs) -> S.AnnualSales:
    def build() -> S.AnnualSales:
        sales = stage(i["fx_disclosed"], "sales")
        firms = stage(S.firm_years(_panel_scores(i), S.sales_totals(sales)), "firm-years")
        return S.AnnualSales(stage(S.scored_sales(sales, firms, IN.MIN_YEAR), "weighted"), firms)

    return shared(i, "weighted", build)


def _weighted(i: Inputs) -> DataFrame:
    return S.quarterly_links(_weighted_sales(i).scored)


def _complete(i: Inputs) -> DataFrame:
    return DG.complete_links(_scored(i))


def _complete_weighted(i: Inputs) -> DataFrame:
    return DG.complete_links(_weighted(i))


def _first(i: Inputs) -> DataFrame:
    return DG.first_degree_equal(_complete(i))


def _degree_table(i: Inputs) -> DataFrame:
    links = _complete(i)
    first = _first(i)
    degrees = [
        first,
        DG.second_degree_equal(links, first),
        DG.third_degree_equal(links, first),
    ]
    return DG.firm_degree_table(links, degrees)


def _reach(i: Inputs) -> DG.Reach:
    return shared(i, "reach", lambda: DG.reach(_complete(i)))


def _walks(i: Inputs) -> DG.Walks:
    """Complete links, packed: what partners at two and three hops are worked out from."""
    return shared(i, "walks", lambda: DG.walks(_complete(i), DG.HUB_LINKS))


def _firm_scored(i: Inputs) -> DataFrame:
    """Links of firms with all their own scores: what the network is built from."""
    return S.with_firm_scores(_scored(i))


def _edges(i: Inputs) -> DataFrame:
    return G.graph_edges(_firm_scored(i))


def _search(i: Inputs) -> G.Search:
    return shared(i, "search", lambda: G.search_all(_edges(i)))


def _exposure(i: Inputs) -> DataFrame:
    return G.node_exposure(_edges(i), _firm_scored(i))


def _esg(i: Inputs) -> DataFrame:
    return DC.esg_scores(i["fx_trucost"], i["fx_inst"])


def _env(i: Inputs) -> DataFrame:
    return DC.environmental_scores(i["fx_trucost"], i["fx_inst"])


def _env_year(i: Inputs) -> DataFrame:
    return DC.environmental_scores_by_year(i["fx_trucost"], i["fx_inst"])


def _esg_decline(i: Inputs) -> DC.Declines:
    return DC.quarterly_decline(_walks(i), _esg(i))


def _env_decline(i: Inputs) -> DC.Declines:
    return DC.quarterly_decline(_walks(i), _env(i))


def _env_decline_year(i: Inputs) -> DC.Declines:
    return DC.annual_decline(_walks(i), _env_year(i))


def _firm_flags(i: Inputs) -> DataFrame:
    """Flags of firms, for which the declines of all links are not written."""
    return shared(i, "firm_flags", lambda: stage(DC.firm_decline_flag(_env_decline(i)), "firm-flags"))


def _flags_quarter(i: Inputs) -> DataFrame:
    return DC.decline_flags_wide(_firm_flags(i))


def _flags_year(i: Inputs) -> DataFrame:
    return DC.decline_flags_wide(DC.firm_decline_flag(_env_decline_year(i)))


def _ccm(i: Inputs) -> DataFrame:
    return TB.admitted_links(i["fx_ccm"])


def _linked_year(i: Inputs) -> DataFrame:
    return shared(
        i, "linked_year", lambda: stage(M.link_permno_year(_flags_year(i), _ccm(i)), "linked-year")
    )


def _linked_quarter(i: Inputs) -> DataFrame:
    return shared(
        i,
        "linked_quarter",
        lambda: stage(
            M.link_permno_date(_flags_quarter(i), i["fx_fundq"], _ccm(i)), "linked-quarter"
        ),
    )


# -- sources and sinks -------------------------------------------------------


@query("o_orderkey:l o_custkey:l o_orderdate:t o_totalprice:d o_orderstatus:s")
def scan_csv_roundtrip(i: Inputs) -> DataFrame:
    path = f"{staging_root(i.spark)}/orders-csv-{uuid.uuid4().hex}"
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"]
    orders = i["orders"].withColumn("o_orderdate", F.to_date("o_orderdate")).select(*columns)
    TB.write_csv(orders, path)
    return TB.read_csv(i.spark, path, orders.schema)


@query("l_orderkey:l l_suppkey:l l_quantity:d")
def scan_pruned(i: Inputs) -> DataFrame:
    return TB.read_parquet(
        i.spark, f"{i.folder}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_quantity"]
    )


@query("o_orderkey:l o_custkey:l o_orderdate:t o_totalprice:d")
def scan_date_range(i: Inputs) -> DataFrame:
    return TB.between_dates(i["orders"], "o_orderdate", "1996-01-31", "1998-06-30")


@query("gvkey:l lpermno:l linktype:s linkdt:t linkenddt:t")
def scan_linktype_in(i: Inputs) -> DataFrame:
    return _ccm(i)


@query("term:s tag:s")
def lexicon_sentiment(i: Inputs) -> DataFrame:
    return LX.sentiment_lexicon(i.dictionary())


@query("term:s tag:s")
def lexicon_risk(i: Inputs) -> DataFrame:
    return LX.risk_lexicon(i.synonym_lines())


@query("term:s weight:d")
def lexicon_bigrams(i: Inputs) -> DataFrame:
    return LX.bigram_lexicon(i.bigram_table())


@query("term:s n:l")
def lexicon_covid(i: Inputs) -> DataFrame:
    """Covid terms with their occurrences in the transcripts and documents."""
    texts = i["conversations"].select("text").unionAll(i["documents"].select("text"))
    terms = LX.covid_lexicon(i.spark)
    counted = (
        texts.select(F.explode(words_of("text")).alias("term"))
        .join(terms.select("term"), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return terms.join(counted, "term", "left").fillna(0, ["n"])


# -- projections and filters -------------------------------------------------


@query("orderkey:l linenumber:l quantity:d")
def head_rows(i: Inputs) -> DataFrame:
    rows = i["lineitem"].select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_partkey").alias("partkey"),
    )
    return TB.first_rows(rows, 5, ["orderkey", "linenumber", "partkey", "quantity"])


@query("gvkey:l quarter:l covid:d")
def distinct_rows(i: Inputs) -> DataFrame:
    return i["fx_pol"].select(
        "gvkey", F.quarter("date").alias("quarter"), F.col("Covid_Exposure").alias("covid")
    ).distinct()


@query("gvkey:l date:t Risk:d Covid_Exposure:d")
def dropna_any(i: Inputs) -> DataFrame:
    return i["fx_pol"].dropna("any")


@query("source_company_id:l target_company_id:l rel_type:s start_:t end_:t")
def relation_clean(i: Inputs) -> DataFrame:
    return P.relation_clean(i["fx_relation"], IN.OPEN_END)


@query("d:t year:l month:l quarter:l q_case:l q_month:l q_end:t label:s date_label:s back_year:l back_quarter:l")
def calendar_case(i: Inputs) -> DataFrame:
    days = i["orders"].select(F.to_date("o_orderdate").alias("d")).distinct()
    dated = days.withColumns(
        {"year": F.year("d"), "month": F.month("d"), "quarter": F.quarter("d")}
    )
    back = C.quarter_index("year", "quarter") - 2
    return dated.withColumns(
        {
            "q_case": C.quarter_of_month("month"),
            "q_month": C.month_of_quarter("quarter"),
            "q_end": C.quarter_end("year", "quarter"),
            "label": C.period_label("year", "quarter"),
            "date_label": C.date_label("year", "quarter"),
            "back_year": C.year_of_index(back),
            "back_quarter": C.quarter_of_index(back),
        }
    )


@query("source_company_id:l year:l quarter:l date:t")
def firm_quarter_grid(i: Inputs) -> DataFrame:
    return P.firm_quarter_grid(i["fx_relation"], IN.FIRST_YEAR, IN.LAST_YEAR)


PANEL_SPEC = (
    "source_company_id:l target_company_id:l rel_type:s year:l quarter:l date:t SOURCE_name:s "
    "TARGET_name:s SOURCE_cusip:s TARGET_cusip:s SOURCE_isin:s TARGET_isin:s"
)


@query(PANEL_SPEC)
def panel_expand(i: Inputs) -> DataFrame:
    return i.panel()


@query(PANEL_SPEC)
def panel_filter_any_id(i: Inputs) -> DataFrame:
    return i.identified()


def _identified(i: Inputs) -> DataFrame:
    return shared(i, "identified", lambda: stage(i.identified(), "panel-identified"))


@query("route:s rel_type:s n:l")
def link_cascade_split(i: Inputs) -> DataFrame:
    routed = P.route(_identified(i))
    return routed.groupBy("route", "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("source_company_id:l target_company_id:l year:l quarter:l rel_type:s")
def link_unrouted(i: Inputs) -> DataFrame:
    """Rows that no route takes; the routes are disjoint, so one filter suffices."""
    return P.routed(_identified(i), "none")


LINK_SPEC = (
    "source_company_id:l target_company_id:l rel_type:s year:l quarter:l SOURCE_gvkey:l TARGET_gvkey:l"
)


@query(LINK_SPEC)
def link_cusip(i: Inputs) -> DataFrame:
    return P.link_cusip(_identified(i), i["fx_link"])


@query(LINK_SPEC)
def link_isin(i: Inputs) -> DataFrame:
    return P.link_isin(_identified(i), i["fx_link"], i["fx_dir"])


@query("gvkey:l CUSIPH:s cik:l coname:s FNDATE:t LNDATE:t")
def linktable_semi(i: Inputs) -> DataFrame:
    return P.scored_link_table(i["fx_link"], i["fx_pol"], i["fx_cc"])


def _name_link(i: Inputs) -> DataFrame:
    def build() -> DataFrame:
        table = P.scored_link_table(i["fx_link"], i["fx_pol"], i["fx_cc"])
        return stage(N.matched_link_table(table, P.panel_names(_identified(i))), "name-link")

    return shared(i, "name_link", build)


@query(LINK_SPEC)
def link_name(i: Inputs) -> DataFrame:
    return P.link_name(_identified(i), _name_link(i))


def _routes(i: Inputs) -> list[DataFrame]:
    rows = _identified(i)
    return [
        P.link_cusip(rows, i["fx_link"]),
        P.link_isin(rows, i["fx_link"], i["fx_dir"]),
        P.link_name(rows, _name_link(i)),
    ]


@query(LINK_SPEC + " SOURCE_name:s TARGET_name:s")
def links_union(i: Inputs) -> DataFrame:
    return P.links_union(*_routes(i))


# -- names -------------------------------------------------------------------


@query("id:l base_a:s base_b:s")
def name_normalise(i: Inputs) -> DataFrame:
    return i["fx_names"].select(
        "id", base_name("name_a").alias("base_a"), base_name("name_b").alias("base_b")
    )


def _name_matches(i: Inputs) -> DataFrame:
    def build() -> DataFrame:
        names = i["fx_names"].select(
            base_name("name_a").alias("name_a"), base_name("name_b").alias("name_b")
        )
        return stage(N.name_matches(names, "name_a", names, "name_b"), "name-matches")

    return shared(i, "name_matches", build)


@query("name_a:s name_b:s score:l rank:l")
def name_match_topk(i: Inputs) -> DataFrame:
    return N.best_matches(_name_matches(i))


@query("name_a:s name_b:s score:l")
def name_match_best(i: Inputs) -> DataFrame:
    return N.best_matches(_name_matches(i), 1)


@query("name_a:s name_b:s score:l")
def name_match_pairs(i: Inputs) -> DataFrame:
    return _name_matches(i)


# -- transcripts -------------------------------------------------------------


def _lexicon(i: Inputs) -> DataFrame:
    return shared(i, "lexicon", lambda: stage(i.lexicon(), "lexicon"))


def _bigrams(i: Inputs) -> DataFrame:
    return shared(i, "bigrams", lambda: stage(i.bigrams(), "bigrams"))


@query("transcriptid:l ord:l cleaned:s n_words:l")
def text_clean(i: Inputs) -> DataFrame:
    return T.cleaned_components(i["fx_transcripts"])


@query("transcriptid:l text:s")
def transcript_concat(i: Inputs) -> DataFrame:
    return T.concat_components(i["fx_transcripts"])


@query("bigram:s n:l")
def bigram_counts(i: Inputs) -> DataFrame:
    return T.bigram_counts(i["fx_transcripts"])


@query("transcriptid:l pos:l bigram:s window:s")
def bigram_windows(i: Inputs) -> DataFrame:
    return T.bigram_windows(i["fx_transcripts"])


@query("transcriptid:l Risk:l Sentiment:l Covid:l total_words:l")
def transcript_unconditional(i: Inputs) -> DataFrame:
    return T.unconditional_scores(i["fx_transcripts"], _lexicon(i))


@query("transcriptid:l Pol:d PRisk:d PSentiment:d")
def transcript_conditional(i: Inputs) -> DataFrame:
    return T.conditional_scores(i["fx_transcripts"], _lexicon(i), _bigrams(i))


@query("transcriptid:l Risk:d Sentiment:d Covid:d Pol:d PRisk:d PSentiment:d total_words:l")
def transcript_scores(i: Inputs) -> DataFrame:
    return T.transcript_scores(i["fx_transcripts"], _lexicon(i), _bigrams(i))


@query("transcriptid:l Risk:d Sentiment:d Covid:d Pol:d PRisk:d PSentiment:d total_words:l")
def document_scores(i: Inputs) -> DataFrame:
    """The same scores on documents, each one component; some have few words."""
    parts = i["documents"].select(
        F.col("doc_id").alias("transcriptid"), F.lit(0).alias("ord"), F.col("text").alias("componenttext")
    )
    return T.transcript_scores(parts, _lexicon(i), _bigrams(i))


# -- scores and links --------------------------------------------------------


@query("side:s firm_gvkey:l partner_gvkey:l year:l quarter:l sale_cs:d")
def disclosed_links(i: Inputs) -> DataFrame:
    return S.disclosed_links(i["fx_disclosed"])


@query("gvkey:l year:l quarter:l pol:d covid:d cc:d")
def score_panel(i: Inputs) -> DataFrame:
    return _panel_scores(i)


SCORED_SPEC = (
    "side:s firm_gvkey:l partner_gvkey:l year:l quarter:l firm_pol:d firm_covid:d firm_cc:d "
    "partner_pol:d partner_covid:d partner_cc:d"
)


@query(SCORED_SPEC)
def score_attach(i: Inputs) -> DataFrame:
    return _scored(i)


@query("side:s firm_gvkey:l year:l sale_t:d")
def sales_totals(i: Inputs) -> DataFrame:
    return S.sales_totals(i["fx_disclosed"])


@query(
    "side:s firm_gvkey:l partner_gvkey:l year:l quarter:l sale_cs:d sale_t:d sale_r:d "
    "partner_pol_weighted:d partner_covid_weighted:d partner_cc_weighted:d"
)
def value_weighted_links(i: Inputs) -> DataFrame:
    return _weighted(i)


@query(
    "side:s firm_gvkey:l partner_gvkey:l year:l quarter:l sale_cs:d larger_pol:l larger_covid:l larger_cc:l "
    "larger_pol_w:l larger_covid_w:l larger_cc_w:l"
)
def partner_larger_flags(i: Inputs) -> DataFrame:
    return S.larger_partner_flags(S.larger_partner_flags(_weighted(i)), weighted=True)


SHARE_SPEC = "side:s year:l quarter:l pol_prop:d covid_prop:d cc_prop:d firm_count:l"


@query(SHARE_SPEC)
def partner_larger_props(i: Inputs) -> DataFrame:
    return S.larger_partner_shares(S.larger_partner_flags(_weighted(i)))


@query(SHARE_SPEC)
def partner_larger_props_weighted(i: Inputs) -> DataFrame:
    return S.larger_partner_shares(S.larger_partner_flags(_weighted(i), True), True)


@query("metric:s year:l quarter:l prop:d firm_count:l")
def partner_larger_props_long(i: Inputs) -> DataFrame:
    """Shares over relation links, written one folder per metric and read back."""
    long = S.shares_long(S.larger_partner_shares(S.larger_partner_flags(_scored(i))))
    path = f"{staging_root(i.spark)}/shares-{uuid.uuid4().hex}"
    TB.write_parquet(long, path, ["metric"])
    return i.spark.read.schema(long.schema).parquet(path)


@query("firm_gvkey:l year:l quarter:l firm_pol:d firm_covid:d firm_cc:d")
def firm_universe(i: Inputs) -> DataFrame:
    return S.firm_universe(_firm_scored(i))


@query("firm_gvkey:l year:l quarter:l supplier_gvkey:l customer_gvkey:l sc_pol:d sc_covid:d sc_cc:d")
def firm_meta(i: Inputs) -> DataFrame:
    return S.firm_meta(_weighted_sales(i))


@query(SCORED_SPEC)
def firm_lookup(i: Inputs) -> DataFrame:
    return S.firm_rows(_scored(i), 1004)


# -- degrees -----------------------------------------------------------------

DEGREE_SPEC = "firm_gvkey:l year:l quarter:l pol:d covid:d cc:d"


def _register_sides() -> None:
    makers: dict[str, Builder] = {
        "degree1_ew": lambda i: _first(i),
        "degree2_ew": lambda i: DG.second_degree_equal(_complete(i), _first(i)),
        "degree3_ew": lambda i: DG.third_degree_equal(_complete(i), _first(i)),
        "degree1_vw": lambda i: DG.first_degree_value(_complete_weighted(i)),
    }
    for name, make in makers.items():
        for side in ("supplier", "customer"):
            query(DEGREE_SPEC, f"{name}_{side}")(
                lambda i, make=make, side=side: DG.one_side(make(i), side)
            )


_register_sides()


@query("side:s " + DEGREE_SPEC)
def degree2_ew_paths(i: Inputs) -> DataFrame:
    links = _complete_weighted(i)
    return DG.second_degree_paths(links, DG.first_degree_equal(links))


@query("side:s " + DEGREE_SPEC)
def degree2_vw_paths(i: Inputs) -> DataFrame:
    links = _complete_weighted(i)
    return DG.second_degree_paths(links, DG.first_degree_value(links))


TABLE_SPEC = "firm_gvkey:l year:l quarter:l firm_pol:d firm_covid:d firm_cc:d " + " ".join(
    f"degree{d}_{s}_{m}:d" for d in (1, 2, 3) for s in ("supplier", "customer") for m in S.METRICS
)


@query(TABLE_SPEC)
def firm_degree_table(i: Inputs) -> DataFrame:
    return _degree_table(i)


@query("firms:l firms_two_degrees:l firms_three_degrees:l")
def coverage_counts(i: Inputs) -> DataFrame:
    return DG.coverage_counts(_degree_table(i))


@query("year:l n:l")
def coverage_by_year(i: Inputs) -> DataFrame:
    return DG.coverage_by_year(_degree_table(i))


LONG_LINK_SPEC = "side:s degree:l firm_gvkey:l partner_gvkey:l year:l quarter:l"


@query(LONG_LINK_SPEC)
def degree_links(i: Inputs) -> DataFrame:
    return DG.listed_links(_walks(i))


@query(LONG_LINK_SPEC)
def link_cycles(i: Inputs) -> DataFrame:
    return DG.cycle_links(_reach(i))


@query("side:s degree:l avg_partners:d")
def avg_partner_count(i: Inputs) -> DataFrame:
    return DG.mean_partner_count(_walks(i))


# -- declines ----------------------------------------------------------------

SCORE_SPEC = "gvkey:l institutionid:l scoredate:t year:l quarter:l scorevalue:d"


@query(SCORE_SPEC)
def esg_score_prep(i: Inputs) -> DataFrame:
    return _esg(i)


@query(SCORE_SPEC)
def env_score_prep(i: Inputs) -> DataFrame:
    return _env(i)


@query("firm_gvkey:l year:l quarter:l firm_pol:d degree1_supplier_pol:d scorevalue:d")
def esg_firm_ffill(i: Inputs) -> DataFrame:
    return DC.fill_firm_scores(_degree_table(i), _esg(i))


@query("year:l firms:l n:l")
def coverage_with_esg_score(i: Inputs) -> DataFrame:
    return DG.scored_coverage(DC.fill_firm_scores(_degree_table(i), _esg(i)))


@query("side:s degree:l firms:l partners:l")
def decline_table_counts(i: Inputs) -> DataFrame:
    return DC.decline_coverage(_esg_decline(i))


@query(
    "firm_gvkey:l year:l quarter:l "
    + " ".join(f"degree1_{w}_{s}_{m}:d" for w in ("ew", "vw") for s in ("supplier", "customer") for m in S.METRICS)
)
def firm_first_degree_table(i: Inputs) -> DataFrame:
    links = _complete_weighted(i)
    return DG.firm_first_degree_table(links, DG.first_degree_equal(links), DG.first_degree_value(links))


@query("gvkey:l year:l quarter:l covid:d covid_filled:d")
def ffill_panel(i: Inputs) -> DataFrame:
    filled = forward_fill("covid", ["gvkey"], ["year", "quarter"])
    return _panel_scores(i).withColumn("covid_filled", filled)


DECLINE_SPEC = LONG_LINK_SPEC + " scorevalue:d lst_score:d decline:l"


@query(DECLINE_SPEC)
def esg_decline_quarterly(i: Inputs) -> DataFrame:
    return DC.listed_declines(_esg_decline(i))


@query(DECLINE_SPEC)
def env_decline_quarterly(i: Inputs) -> DataFrame:
    return DC.listed_declines(_env_decline(i))


@query(DECLINE_SPEC.replace(" quarter:l", ""))
def env_decline_annual(i: Inputs) -> DataFrame:
    return DC.listed_declines(_env_decline_year(i))


@query(DECLINE_SPEC + " decline_rate:d")
def decline_rate(i: Inputs) -> DataFrame:
    return DC.with_decline_rate(_esg_decline(i))


@query("side:s degree:l mean:d std:d q25:d q75:d median:d")
def decline_rate_summary(i: Inputs) -> DataFrame:
    return DC.decline_rate_summary(_esg_decline(i))


@query("side:s degree:l firm_gvkey:l year:l quarter:l flag:l")
def decline_firm_flag(i: Inputs) -> DataFrame:
    return _firm_flags(i)


@query("side:s degree:l share:d")
def decline_flag_share(i: Inputs) -> DataFrame:
    return DC.flagged_share(_esg_decline(i))


FLAG_SPEC = " ".join(f"{c}:l" for c in DC.FLAG_COLUMNS.values())


@query("firm_gvkey:l year:l quarter:l " + FLAG_SPEC)
def env_score_wide(i: Inputs) -> DataFrame:
    return _flags_quarter(i)


@query("firm_gvkey:l year:l " + FLAG_SPEC)
def env_score_wide_year(i: Inputs) -> DataFrame:
    return _flags_year(i)


# -- graph -------------------------------------------------------------------


@query("year:l quarter:l source:l target:l")
def graph_edges(i: Inputs) -> DataFrame:
    return _edges(i)


@query("n_nodes:l")
def graph_node_count(i: Inputs) -> DataFrame:
    return G.node_count(_edges(i))


@query("year:l quarter:l node:l degree_centrality:d")
def degree_centrality(i: Inputs) -> DataFrame:
    return G.degree_centrality(_edges(i))


@query("year:l quarter:l node:l closeness_centrality:d")
def closeness_centrality(i: Inputs) -> DataFrame:
    return G.closeness_centrality(_search(i))


@query("year:l quarter:l node:l betweenness_centrality:d")
def betweenness_centrality(i: Inputs) -> DataFrame:
    return G.betweenness_centrality(_search(i))


@query("year:l quarter:l node:l degree_centrality:d betweenness_centrality:d closeness_centrality:d")
def centrality_table(i: Inputs) -> DataFrame:
    return G.centrality_table(_edges(i), _search(i))


@query("year:l quarter:l node:l exposure:d")
def node_exposure(i: Inputs) -> DataFrame:
    return _exposure(i)


@query("node:l")
def nodes_majority_lower(i: Inputs) -> DataFrame:
    return G.nodes_majority_lower(_edges(i), _exposure(i))


@query("node:l")
def nodes_all_higher(i: Inputs) -> DataFrame:
    return G.nodes_all_higher(_edges(i), _exposure(i), *IN.GRAPH_PERIOD)


@query("year:l quarter:l source:l target:l")
def ego_network(i: Inputs) -> DataFrame:
    return G.ego_network(_edges(i), *IN.GRAPH_PERIOD, IN.CENTER)


@query("node:l hop:l exposure:d")
def ego_nodes(i: Inputs) -> DataFrame:
    year, quarter = IN.GRAPH_PERIOD
    here = _exposure(i).filter((F.col("year") == year) & (F.col("quarter") == quarter))
    return G.ego_nodes(_edges(i), year, quarter, IN.CENTER).join(here, "node")


# -- market ------------------------------------------------------------------


@query("firm_gvkey:l firm_permno:l year:l " + FLAG_SPEC)
def link_permno_year(i: Inputs) -> DataFrame:
    return M.link_permno_year(_flags_year(i), _ccm(i))


@query("firm_gvkey:l firm_permno:l year:l quarter:l datadate:t " + FLAG_SPEC)
def link_permno_date(i: Inputs) -> DataFrame:
    return M.link_permno_date(_flags_quarter(i), i["fx_fundq"], _ccm(i))


@query("permno:l year:l quarter:l size:d")
def ctl_size(i: Inputs) -> DataFrame:
    return M.size(i["fx_msf"])


@query("permno:l year:l size:d")
def ctl_size_year(i: Inputs) -> DataFrame:
    return M.size(i["fx_msf"], M.YEARLY)


@query("firm_gvkey:l year:l bm:d")
def ctl_bm_year(i: Inputs) -> DataFrame:
    return M.book_to_market_year(_linked_year(i), i["fx_funda"], i["fx_msf"])


@query("firm_gvkey:l year:l quarter:l bm:d")
def ctl_bm_quarter(i: Inputs) -> DataFrame:
    return M.book_to_market_quarter(_linked_quarter(i), i["fx_fundq"], i["fx_msf"])


@query("permno:l year:l ret:d")
def ctl_return_year(i: Inputs) -> DataFrame:
    return M.past_return_year(i["fx_msf"])


@query("permno:l year:l quarter:l ret:d")
def ctl_return_quarter(i: Inputs) -> DataFrame:
    return M.past_return_quarter(i["fx_msf"])


@query("permno:l year:l prc:d")
def ctl_price_year(i: Inputs) -> DataFrame:
    return M.past_price_year(i["fx_msf"])


@query("permno:l year:l quarter:l prc:d")
def ctl_price_lag2q(i: Inputs) -> DataFrame:
    return M.past_price_quarter(i["fx_msf"])


@query("permno:l year:l vol:d")
def ctl_volume_year(i: Inputs) -> DataFrame:
    return M.past_volume_year(i["fx_msf"])


@query("permno:l year:l quarter:l vol:d")
def ctl_volume_lag2q(i: Inputs) -> DataFrame:
    return M.past_volume_quarter(i["fx_msf"])


@query("gvkey:l fyear:l capx:d tant:d roa:d adv_exp:d")
def ctl_ratios(i: Inputs) -> DataFrame:
    return M.annual_ratios(i["fx_funda"])


@query("gvkey:l year:l quarter:l capx:d tant:d roa:d")
def ctl_ratios_quarter(i: Inputs) -> DataFrame:
    return M.quarterly_ratios(i["fx_fundq"])


@query("gvkey:l year:l quarter:l adv_exp:d")
def ctl_adv_quarter(i: Inputs) -> DataFrame:
    return M.advertising_quarter(i["fx_fundq"], i["fx_funda"])


@query("permno:l year:l quarter:l ret:d port_ret:d")
def compound_returns(i: Inputs) -> DataFrame:
    return M.compound_returns(i["fx_port"], M.QUARTERLY)


@query("horizon:l permno:l year:l excess_return:d")
def excess_return_lead_year(i: Inputs) -> DataFrame:
    return M.excess_return_leads(i["fx_port"], M.YEARLY, YEAR_HORIZONS)


@query("horizon:l permno:l year:l quarter:l excess_return:d")
def excess_return_lead_quarter(i: Inputs) -> DataFrame:
    return M.excess_return_leads(i["fx_port"], M.QUARTERLY, QUARTER_HORIZONS)


@query("horizon:l permno:l year:l quarter:l excess_return:d")
def excess_return_cumulative(i: Inputs) -> DataFrame:
    return M.excess_return_cumulative(i["fx_port"], QUARTER_HORIZONS)


YEAR_HORIZONS = (1, 2, 3, 4)
QUARTER_HORIZONS = (1, 2, 4, 6, 8)


# -- regressions -------------------------------------------------------------


def _sample_year(i: Inputs, ahead: int) -> DataFrame:
    excess = M.excess_return_leads(i["fx_port"], M.YEARLY, [ahead]).drop("horizon")
    return M.regression_sample_year(_linked_year(i), i["fx_msf"], i["fx_funda"], excess)


def _sample_quarter(i: Inputs, excess: DataFrame) -> DataFrame:
    return M.regression_sample_quarter(
        _linked_quarter(i), i["fx_msf"], i["fx_fundq"], i["fx_funda"], excess
    )


SAMPLE_TAIL = " excess_return:d size:d bm:d ret:d vol:d capx:d tant:d roa:d adv_exp:d"


@query("firm_gvkey:l firm_permno:l year:l " + FLAG_SPEC + SAMPLE_TAIL)
def regression_sample(i: Inputs) -> DataFrame:
    return M.usable_rows(_sample_year(i, 1))


@query("firm_gvkey:l firm_permno:l year:l quarter:l " + FLAG_SPEC + SAMPLE_TAIL)
def regression_sample_quarter(i: Inputs) -> DataFrame:
    excess = M.excess_return_leads(i["fx_port"], M.QUARTERLY, [1]).drop("horizon")
    return M.usable_rows(_sample_quarter(i, excess))


def _account_panel(i: Inputs) -> DataFrame:
    """Firm-quarters with return on assets explained by size and investment."""
    accounts = i["fx_fundq"]
    return accounts.select(
        F.col("gvkey").alias("firm_gvkey"),
        C.index_of_date("datadate").alias("t"),
        (ratio("niq", "atq") * 100).alias("roa"),
        F.log("saleq").alias("log_sale"),
        (ratio("capxy", "saleq") * 100).alias("capx"),
    )


PANEL_TERMS = ("log_sale", "capx")


def _panel_model(name: str) -> R.Model:
    return R.Model(name, "roa", PANEL_TERMS, time="t")


def _panel_fit(i: Inputs) -> R.Fit:
    return shared(i, "panel_fit", lambda: R.fit(_account_panel(i), _panel_model("roa")))


@query("model:s term:s estimate:d")
def felm_coefficients(i: Inputs) -> DataFrame:
    return R.coefficient_table(i.spark, [_panel_fit(i)])


@query("model:s term:s se:d t:d")
def felm_clustered_se(i: Inputs) -> DataFrame:
    return R.coefficient_table(i.spark, [_panel_fit(i)])


def _horizon_fits(i: Inputs) -> list[R.Fit]:
    panel = stage(_account_panel(i), "account-panel")

    def one(n: int) -> list[R.Fit]:
        later = lead_by("roa", n, ["firm_gvkey"], ["t"])
        return [R.fit(panel.withColumn("roa", later), _panel_model(f"h{n}"))]

    return R.fit_all([partial(one, n) for n in YEAR_HORIZONS])


@query("model:s term:s estimate:d se:d t:d n:l units:l periods:l r2:d r2_within:d")
def felm_model_table(i: Inputs) -> DataFrame:
    return R.model_table(i.spark, _horizon_fits(i))


MODEL_SPEC = (
    "model:s term:s estimate:d se:d t:d p:d stars:s n:l units:l periods:l df:l r2:d r2_within:d"
)


def _model_pair(sample: DataFrame, name: str, full_time: str, first_time: str) -> list[R.Fit]:
    """The two models of a horizon: all six flags, and first-degree flags only."""
    rows = stage(M.model_columns(sample), "model-rows")
    controls = tuple(M.CONTROLS)
    return [
        R.fit(rows, R.Model(f"{name}-all", "excess_return", (*M.ALL_FLAGS, *controls), time=full_time), True),
        R.fit(rows, R.Model(f"{name}-first", "excess_return", (*M.FIRST_FLAGS, *controls), time=first_time), True),
    ]


@query(MODEL_SPEC)
def felm_annual_models(i: Inputs) -> DataFrame:
    _linked_year(i)

    def one(n: int) -> list[R.Fit]:
        return _model_pair(_sample_year(i, n), f"year{n}", "year", "year")

    return R.model_table(i.spark, R.fit_all([partial(one, n) for n in YEAR_HORIZONS]))


def _quarter_models(i: Inputs, kind: str, excess: Callable[[int], DataFrame]) -> DataFrame:
    _linked_quarter(i)

    def one(n: int) -> list[R.Fit]:
        sample = _sample_quarter(i, excess(n).drop("horizon")).withColumn(
            "year_quarter", C.period_label("year", "quarter")
        )
        # The first-degree model of horizon 1 and every cumulative one absorb the year.
        yearly = kind == "cumulative" or n == 1
        first_time = "year" if yearly else "year_quarter"
        return _model_pair(sample, f"{kind}{n}", "year_quarter", first_time)

    return R.model_table(i.spark, R.fit_all([partial(one, n) for n in QUARTER_HORIZONS]))


@query(MODEL_SPEC)
def felm_quarterly_models(i: Inputs) -> DataFrame:
    return _quarter_models(
        i, "lead", lambda n: M.excess_return_leads(i["fx_port"], M.QUARTERLY, [n])
    )


@query(MODEL_SPEC)
def felm_cumulative_models(i: Inputs) -> DataFrame:
    return _quarter_models(
        i, "cumulative", lambda n: M.excess_return_cumulative(i["fx_port"], [n])
    )
