"""Independent SQL for the queries, run by another engine on the same tables.

Statements are written from the definitions, row by row and path by path, not
from the Spark plans: fills run over full rows, third-degree scores list their
paths, betweenness uses the pair formula, demeaning the balanced closed form.
"""

from __future__ import annotations

import re

from chainrisk.functions.text import LEGAL_FORMS
from chainrisk.operators.decline import FLAG_COLUMNS
from chainrisk.plans import inputs as IN
from chainrisk.plans.catalog import QUARTER_HORIZONS, QUERIES, YEAR_HORIZONS
from chainrisk.sources.lexicons import COVID_TERMS
from chainrisk.sources.tables import LINK_TYPES

METRICS = ("pol", "covid", "cc")


def _larger(a: str, b: str) -> str:
    """Comparison of two means at six decimal places."""
    return f"CASE WHEN round({a} + 1e-9, 6) > round({b} + 1e-9, 6) THEN 1 ELSE 0 END"


def _values(rows: list[tuple]) -> str:
    def text(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


def _base(column: str) -> str:
    end = "[ ,.]+(" + "|".join(LEGAL_FORMS) + ")[.]?$"
    once = f"regexp_replace(trim(lower({column})), '{end}', '')"
    return f"trim(regexp_replace({once}, '{end}', ''))"


def _clean(column: str) -> str:
    return f"regexp_replace(lower({column}), '[^a-zA-Z ]', '', 'g')"


def _words(column: str) -> str:
    return f"list_filter(string_split({_clean(column)}, ' '), lambda w: w <> '')"


COVID_ROWS = sorted({(re.sub("[^a-z ]", "", t.lower()), "covid") for t in COVID_TERMS})

FILL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
LINK = "side, degree, firm_gvkey, partner_gvkey"


def _scored(links: str, extra: str) -> str:
    f = ", ".join(f"f.{m} AS firm_{m}" for m in METRICS)
    p = ", ".join(f"p.{m} AS partner_{m}" for m in METRICS)
    return f"""SELECT DISTINCT l.side, l.firm_gvkey, l.partner_gvkey, l.year, l.quarter{extra}, {f}, {p}
      FROM {links} l
      LEFT JOIN sp f ON f.gvkey = l.firm_gvkey AND f.year = l.year AND f.quarter = l.quarter
      LEFT JOIN sp p ON p.gvkey = l.partner_gvkey AND p.year = l.year AND p.quarter = l.quarter
      WHERE l.year >= {IN.MIN_YEAR}"""


def _complete(source: str, *more: str) -> str:
    cols = [f"{r}_{m}" for r in ("firm", "partner") for m in METRICS] + list(more)
    return f"SELECT * FROM {source} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols)


def _quarter_decline(scores: str) -> str:
    return f"""
      SELECT {LINK}, year, quarter, sc AS scorevalue, ls AS lst_score, CASE WHEN sc < ls THEN 1 ELSE 0 END AS decline
      FROM (SELECT *, last_value(lst IGNORE NULLS) OVER (PARTITION BY {LINK}
                ORDER BY year, quarter, sc NULLS FIRST, lst NULLS FIRST {FILL}) AS ls
            FROM (SELECT DISTINCT f.side, f.degree, f.firm_gvkey, f.partner_gvkey, f.year, f.quarter, f.sc, s.scorevalue AS lst
                  FROM (SELECT *, last_value(scorevalue IGNORE NULLS) OVER (PARTITION BY {LINK}
                            ORDER BY year, quarter, scorevalue NULLS FIRST {FILL}) AS sc
                        FROM (SELECT DISTINCT l.side, l.degree, l.firm_gvkey, l.partner_gvkey, l.year, l.quarter, s.scorevalue
                              FROM dlk l LEFT JOIN {scores} s
                                ON s.gvkey = l.partner_gvkey AND s.year = l.year AND s.quarter = l.quarter)) f
                  LEFT JOIN {scores} s
                    ON s.gvkey = f.partner_gvkey AND s.year = f.year - 1 AND s.quarter = f.quarter))
      WHERE sc IS NOT NULL AND ls IS NOT NULL"""


def _dated_scores(where: str) -> str:
    return f"""SELECT i.gvkey, t.institutionid, t.scoredate, year(t.scoredate) AS year, quarter(t.scoredate) AS quarter, t.scorevalue
      FROM (SELECT DISTINCT * FROM fx_trucost WHERE {where}) t JOIN fx_inst i USING (institutionid)
      WHERE t.scorevalue IS NOT NULL"""


ENV = (
    "dimensionname = 'Environmental Dimension' AND csascoretypename = 'Modeled' AND scoretype = 'Dimension' "
    "AND aspectname = 'Environmental Dimension' AND mostrecentsequence = 1"
)


def _wide(flags: str, keys: str) -> str:
    cols = ", ".join(
        f"coalesce(max(flag) FILTER (side = '{s}' AND degree = {d}), 0) AS {name}"
        for (s, d), name in FLAG_COLUMNS.items()
    )
    return f"SELECT {keys}, {cols} FROM {flags} GROUP BY ALL"


def _flags(decline: str, keys: str) -> str:
    return f"SELECT side, degree, {keys}, CASE WHEN sum(decline) / count(*) > 0.5 THEN 1 ELSE 0 END AS flag FROM {decline} GROUP BY ALL"


def _compound(keys: str) -> str:
    return f"""SELECT permno, {keys},
        CASE WHEN count(ret) = count(*) THEN product(1 + ret) END AS ret,
        CASE WHEN count(port_ret) = count(*) THEN product(1 + port_ret / 100) END AS port_ret
      FROM (SELECT *, year(rdate) AS year, quarter(rdate) AS quarter FROM fx_port) GROUP BY permno, {keys}"""


LCS_MASK = (
    "list_transform(string_split({x}, ''), lambda c: list_sum(list_transform(range(length({y})), "
    "lambda j: CASE WHEN substr({y}, j::INT + 1, 1) = c THEN pow2[j::INT + 1] ELSE 0::HUGEINT END))::HUGEINT)"
)


def _name_scores(a: str, b: str) -> str:
    """Token-set scores of all pairs of two name lists that share the first letter."""
    toks = "list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(n), '[^a-z0-9_]', ' ', 'g'), ' '), lambda t: t <> '')))"
    return f"""
      ta AS (SELECT n, {toks} AS k FROM (SELECT DISTINCT {a[0]} AS n FROM {a[1]}) WHERE n IS NOT NULL),
      tb AS (SELECT n, {toks} AS k FROM (SELECT DISTINCT {b[0]} AS n FROM {b[1]}) WHERE n IS NOT NULL),
      np AS (SELECT a.n AS name_a, b.n AS name_b,
               array_to_string(list_filter(a.k, lambda t: list_contains(b.k, t)), ' ') AS i,
               array_to_string(list_filter(a.k, lambda t: NOT list_contains(b.k, t)), ' ') AS x,
               array_to_string(list_filter(b.k, lambda t: NOT list_contains(a.k, t)), ' ') AS y
             FROM ta a JOIN tb b ON left(a.n, 1) = left(b.n, 1) WHERE len(a.k) > 0 AND len(b.k) > 0),
      ns AS (SELECT *, trim(i || ' ' || x) AS c1, trim(i || ' ' || y) AS c2 FROM np),
      nq AS (SELECT *, length(i) AS li, length(c1) AS l1, length(c2) AS l2,
               (SELECT list(power(2, k)::HUGEINT ORDER BY k) FROM range(0, 100) p(k)) AS pow2 FROM ns),
      nf AS (SELECT * FROM nq WHERE 200.0 * least(l1, l2) / (l1 + l2) >= 89.5
               OR (li > 0 AND 200.0 * li / (li + least(l1, l2)) >= 89.5)),
      nl AS (SELECT name_a, name_b, li, l1, l2,
               list_reduce({LCS_MASK.format(x="c1", y="c2")},
                 lambda v, m: ((v + (v & m)) | (v - (v & m))) & (pow2[l2 + 1] - 1), pow2[l2 + 1] - 1) AS bits,
               pow2 FROM nf),
      nm AS (SELECT name_a, name_b, greatest(
               CASE WHEN li > 0 THEN round_even(100.0 * (2 * li) / (li + l1), 0) ELSE 0 END,
               CASE WHEN li > 0 THEN round_even(100.0 * (2 * li) / (li + l2), 0) ELSE 0 END,
               round_even(100.0 * (2 * (l2 - bit_count(bits))) / (l1 + l2), 0))::BIGINT AS score FROM nl)"""


CTES: dict[str, str] = {k: v.replace("STRING", "VARCHAR") for k, v in IN.STANDINS.items()}
CTES |= {
    # lexicons: marked words and all blank-separated words of the documents, counted word pairs of the transcripts
    "dic": f"SELECT DISTINCT unnest({_words('text')}) AS w FROM documents",
    "lex": f"""SELECT w AS term, 'positive' AS tag FROM dic WHERE length(w) % 5 = 0 UNION ALL SELECT w, 'negative' FROM dic WHERE length(w) % 7 = 0
      UNION ALL SELECT DISTINCT term, 'risk' FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS term FROM documents) WHERE term <> ''
      UNION ALL SELECT * FROM (VALUES {_values(COVID_ROWS)}) v(term, tag)""",
    "pw": f"SELECT {_words('text')} AS w FROM conversations",
    "big": """SELECT term, count(*) * 0.125 AS weight FROM
      (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM pw) GROUP BY term""",
    # transcripts as one word list each
    "tw": f"""SELECT transcriptid, {_words("string_agg(componenttext, ' ' ORDER BY ord)")} AS w
      FROM fx_transcripts GROUP BY transcriptid""",
    "dw": f"SELECT doc_id AS transcriptid, {_words('text')} AS w FROM documents",
    # relations and panel
    "qe": f"""SELECT y AS year, k AS quarter, last_day(make_date(y::BIGINT, k::BIGINT * 3, 1::BIGINT)) AS date
      FROM range({IN.FIRST_YEAR}, {IN.LAST_YEAR + 1}) a(y), range(1, 5) b(k)""",
    "rel": f"""SELECT * REPLACE (CASE WHEN end_ = DATE '4000-01-01' THEN DATE '{IN.OPEN_END}' ELSE end_ END AS end_) FROM fx_relation""",
    "pan": """SELECT DISTINCT r.source_company_id, r.target_company_id, r.rel_type, q.year, q.quarter, q.date, r.SOURCE_name, r.TARGET_name,
        left(r.SOURCE_cusip, 8) AS SOURCE_cusip, left(r.TARGET_cusip, 8) AS TARGET_cusip, r.SOURCE_isin, r.TARGET_isin
      FROM rel r JOIN qe q ON q.date >= r.start_ AND q.date <= r.end_""",
    "pid": f"""SELECT * REPLACE ({_base('SOURCE_name')} AS SOURCE_name, {_base('TARGET_name')} AS TARGET_name) FROM pan
      WHERE (SOURCE_cusip IS NOT NULL OR SOURCE_name IS NOT NULL OR SOURCE_isin IS NOT NULL)
        AND (TARGET_cusip IS NOT NULL OR TARGET_name IS NOT NULL OR TARGET_isin IS NOT NULL)""",
    "pcusip": "SELECT * FROM pid WHERE SOURCE_cusip IS NOT NULL AND TARGET_cusip IS NOT NULL",
    "pisin": """SELECT * FROM pid WHERE NOT (SOURCE_cusip IS NOT NULL AND TARGET_cusip IS NOT NULL)
      AND SOURCE_isin IS NOT NULL AND TARGET_isin IS NOT NULL""",
    "pname": """SELECT * FROM pid WHERE NOT (SOURCE_cusip IS NOT NULL AND TARGET_cusip IS NOT NULL)
      AND NOT (SOURCE_isin IS NOT NULL AND TARGET_isin IS NOT NULL) AND SOURCE_name IS NOT NULL AND TARGET_name IS NOT NULL""",
    "pnone": """SELECT * FROM pid WHERE NOT (SOURCE_cusip IS NOT NULL AND TARGET_cusip IS NOT NULL)
      AND NOT (SOURCE_isin IS NOT NULL AND TARGET_isin IS NOT NULL) AND NOT (SOURCE_name IS NOT NULL AND TARGET_name IS NOT NULL)""",
    "lcusip": """SELECT a.*, b.gvkey AS SOURCE_gvkey, c.gvkey AS TARGET_gvkey FROM pcusip a
      LEFT JOIN fx_link b ON a.SOURCE_cusip = b.CUSIPH AND a.date BETWEEN b.FNDATE AND b.LNDATE
      LEFT JOIN fx_link c ON a.TARGET_cusip = c.CUSIPH AND a.date BETWEEN c.FNDATE AND c.LNDATE""",
    "lisin": """SELECT a.*, b.gvkey AS SOURCE_gvkey, c.gvkey AS TARGET_gvkey FROM pisin a
      LEFT JOIN fx_dir d ON a.SOURCE_isin = d.isin
      LEFT JOIN fx_link b ON d.cikcode = b.cik AND a.date BETWEEN b.FNDATE AND b.LNDATE
      LEFT JOIN fx_dir e ON a.TARGET_isin = e.isin
      LEFT JOIN fx_link c ON e.cikcode = c.cik AND a.date BETWEEN c.FNDATE AND c.LNDATE""",
    "lsemi": "SELECT DISTINCT * FROM fx_link WHERE gvkey IN (SELECT gvkey FROM fx_pol UNION SELECT gvkey FROM fx_cc)",
    "lbase": f"SELECT DISTINCT {_base('coname')} AS coname, gvkey, FNDATE, LNDATE FROM lsemi",
    "pnames": "SELECT SOURCE_name AS n FROM pname UNION SELECT TARGET_name FROM pname",
    "lname": """SELECT a.*, b.gvkey AS SOURCE_gvkey, c.gvkey AS TARGET_gvkey FROM (SELECT DISTINCT * FROM pname) a
      LEFT JOIN nlink b ON a.SOURCE_name = b.coname AND a.date BETWEEN b.FNDATE AND b.LNDATE
      LEFT JOIN nlink c ON a.TARGET_name = c.coname AND a.date BETWEEN c.FNDATE AND c.LNDATE""",
    "nlink": """SELECT DISTINCT m.name_b AS coname, l.gvkey, l.FNDATE, l.LNDATE FROM lbase l JOIN
      (SELECT name_a, name_b, row_number() OVER (PARTITION BY name_a ORDER BY score DESC, name_b) AS r FROM nm WHERE score >= 90) m
      ON m.name_a = l.coname AND m.r = 1""",
    # links and scores
    "lk": """SELECT DISTINCT CASE rel_type WHEN 'SUPPLIER' THEN 'supplier' WHEN 'CUSTOMER' THEN 'customer' END AS side,
        SOURCE_gvkey AS firm_gvkey, TARGET_gvkey AS partner_gvkey, year, quarter
      FROM (SELECT * FROM lcusip UNION ALL SELECT * FROM lisin UNION ALL SELECT * FROM lname)
      WHERE SOURCE_gvkey IS NOT NULL AND TARGET_gvkey IS NOT NULL AND rel_type IN ('SUPPLIER', 'CUSTOMER')""",
    "sp": """SELECT coalesce(a.gvkey, b.gvkey) AS gvkey, coalesce(a.year, b.year) AS year, coalesce(a.quarter, b.quarter) AS quarter, pol, covid, cc
      FROM (SELECT gvkey, year(date) AS year, quarter(date) AS quarter, avg(Risk) AS pol, avg(Covid_Exposure) AS covid FROM fx_pol GROUP BY ALL) a
      FULL JOIN (SELECT gvkey, year, quarter, avg(cc_expo_ew) AS cc FROM fx_cc GROUP BY ALL) b
        ON a.gvkey = b.gvkey AND a.year = b.year AND a.quarter = b.quarter""",
    "dl": """SELECT d.*, q.quarter FROM
        (SELECT 'supplier' AS side, GVKEY2 AS firm_gvkey, GVKEY1 AS partner_gvkey, y AS year, SALECS AS sale_cs FROM fx_disclosed
         UNION ALL SELECT 'customer', GVKEY1, GVKEY2, y, SALECS FROM fx_disclosed) d, range(1, 5) q(quarter)""",
    "fs": _scored("lk", ""),
    "ds": _scored("dl", ", l.sale_cs"),
    "st": """SELECT 'supplier' AS side, GVKEY2 AS firm_gvkey, y AS year, sum(greatest(SALECS, 0)) AS sale_t FROM fx_disclosed GROUP BY ALL
      UNION ALL SELECT 'customer', GVKEY1, y, sum(greatest(SALECS, 0)) FROM fx_disclosed GROUP BY ALL""",
    "vw": """SELECT *, partner_pol * sale_r AS partner_pol_weighted, partner_covid * sale_r AS partner_covid_weighted, partner_cc * sale_r AS partner_cc_weighted
      FROM (SELECT d.*, t.sale_t, CASE WHEN t.sale_t <> 0 THEN d.sale_cs / t.sale_t END AS sale_r
            FROM ds d LEFT JOIN st t ON t.side = d.side AND t.firm_gvkey = d.firm_gvkey AND t.year = d.year)""",
    "fl": f"""SELECT *, {", ".join(f"{_larger(f'partner_{m}', f'firm_{m}')} AS larger_{m}, {_larger(f'partner_{m}_weighted', f'firm_{m}')} AS larger_{m}_w" for m in METRICS)}
      FROM vw WHERE firm_pol IS NOT NULL AND firm_covid IS NOT NULL AND firm_cc IS NOT NULL""",
    "fc": _complete("fs"),
    # links of firms with own scores (network) and complete links (degrees)
    "fo": "SELECT * FROM fs WHERE firm_pol IS NOT NULL AND firm_covid IS NOT NULL AND firm_cc IS NOT NULL",
    "ck": "SELECT DISTINCT side, firm_gvkey, partner_gvkey, year, quarter FROM fc",
    "dc": _complete("vw", "sale_cs", "sale_t", "sale_r"),
    "d1": "SELECT side, firm_gvkey, year, quarter, avg(partner_pol) AS pol, avg(partner_covid) AS covid, avg(partner_cc) AS cc FROM fc GROUP BY ALL",
    "d2": """SELECT l.side, l.firm_gvkey, l.year, l.quarter, avg(d.pol) AS pol, avg(d.covid) AS covid, avg(d.cc) AS cc
      FROM fc l JOIN d1 d ON d.side = l.side AND d.firm_gvkey = l.partner_gvkey AND d.year = l.year AND d.quarter = l.quarter GROUP BY ALL""",
    "d3": """SELECT a.side, a.firm_gvkey, a.year, a.quarter, avg(d.pol) AS pol, avg(d.covid) AS covid, avg(d.cc) AS cc
      FROM fc a LEFT JOIN fc b ON b.side = a.side AND b.firm_gvkey = a.partner_gvkey AND b.year = a.year AND b.quarter = a.quarter
      LEFT JOIN d1 d ON d.side = b.side AND d.firm_gvkey = b.partner_gvkey AND d.year = b.year AND d.quarter = b.quarter GROUP BY ALL""",
    "e1": "SELECT side, firm_gvkey, year, quarter, avg(partner_pol) AS pol, avg(partner_covid) AS covid, avg(partner_cc) AS cc FROM dc GROUP BY ALL",
    "v1": "SELECT side, firm_gvkey, year, quarter, sum(partner_pol_weighted) AS pol, sum(partner_covid_weighted) AS covid, sum(partner_cc_weighted) AS cc FROM dc GROUP BY ALL",
    "ft": "SELECT u.*, " + ", ".join(
        f"{t}_{s[0]}.{m} AS degree{d}_{s}_{m}"
        for d, t in ((1, "a"), (2, "b"), (3, "c")) for s in ("supplier", "customer") for m in METRICS
    ) + " FROM (SELECT DISTINCT firm_gvkey, year, quarter, firm_pol, firm_covid, firm_cc FROM fc) u " + " ".join(
        f"LEFT JOIN d{d} {t}_{s[0]} ON {t}_{s[0]}.side = '{s}' AND {t}_{s[0]}.firm_gvkey = u.firm_gvkey AND {t}_{s[0]}.year = u.year AND {t}_{s[0]}.quarter = u.quarter"
        for d, t in ((1, "a"), (2, "b"), (3, "c")) for s in ("supplier", "customer")
    ),
    "cov": """SELECT firm_gvkey, year,
        (degree1_supplier_pol IS NOT NULL OR degree1_customer_pol IS NOT NULL) AND (degree2_supplier_pol IS NOT NULL OR degree2_customer_pol IS NOT NULL) AS two,
        (degree3_supplier_pol IS NOT NULL OR degree3_customer_pol IS NOT NULL) AS three FROM ft""",
    "h2": """SELECT DISTINCT a.side, a.firm_gvkey, b.partner_gvkey, a.year, a.quarter
      FROM ck a JOIN ck b ON b.side = a.side AND b.firm_gvkey = a.partner_gvkey AND b.year = a.year AND b.quarter = a.quarter""",
    "h3": """SELECT DISTINCT a.side, a.firm_gvkey, b.partner_gvkey, a.year, a.quarter
      FROM h2 a JOIN ck b ON b.side = a.side AND b.firm_gvkey = a.partner_gvkey AND b.year = a.year AND b.quarter = a.quarter""",
    "dlk": """SELECT side, 1 AS degree, firm_gvkey, partner_gvkey, year, quarter FROM ck
      UNION ALL SELECT side, 2, firm_gvkey, partner_gvkey, year, quarter FROM h2
      UNION ALL SELECT side, 3, firm_gvkey, partner_gvkey, year, quarter FROM h3""",
    # declines
    "esg": _dated_scores("scoretype = 'S&P Global ESG Score' AND csascoretypename = 'Modeled'"),
    "env": _dated_scores(ENV),
    "envy": f"""SELECT i.gvkey, t.assessmentyear, t.scorevalue FROM (SELECT DISTINCT * FROM fx_trucost WHERE {ENV}) t
      JOIN fx_inst i USING (institutionid) WHERE t.scorevalue IS NOT NULL""",
    "edq": _quarter_decline("esg"),
    "ndq": _quarter_decline("env"),
    "nda": f"""SELECT {LINK}, year, sc AS scorevalue, ls AS lst_score, CASE WHEN sc < ls THEN 1 ELSE 0 END AS decline
      FROM (SELECT *, lag(sc) OVER (PARTITION BY {LINK} ORDER BY year, sc NULLS FIRST) AS ls
            FROM (SELECT *, last_value(scorevalue IGNORE NULLS) OVER (PARTITION BY {LINK} ORDER BY year, scorevalue NULLS FIRST {FILL}) AS sc
                  FROM (SELECT DISTINCT l.side, l.degree, l.firm_gvkey, l.partner_gvkey, l.year, s.scorevalue
                        FROM dlk l LEFT JOIN envy s ON s.gvkey = l.partner_gvkey AND s.assessmentyear = l.year)))
      WHERE sc IS NOT NULL AND ls IS NOT NULL""",
    "nfq": _flags("ndq", "firm_gvkey, year, quarter"),
    "nfa": _flags("nda", "firm_gvkey, year"),
    "nwq": _wide("nfq", "firm_gvkey, year, quarter"),
    "nwa": _wide("nfa", "firm_gvkey, year"),
    # graph
    "ge": """SELECT DISTINCT year, quarter, CASE side WHEN 'supplier' THEN partner_gvkey ELSE firm_gvkey END AS source,
        CASE side WHEN 'supplier' THEN firm_gvkey ELSE partner_gvkey END AS target FROM fo""",
    "gn": "SELECT year, quarter, source AS node FROM ge UNION SELECT year, quarter, target FROM ge",
    "gs": "SELECT year, quarter, count(*) AS n FROM gn GROUP BY ALL",
    "walk": """SELECT year, quarter, source AS s, target AS t, 1 AS d FROM ge
      UNION SELECT w.year, w.quarter, w.s, e.target, w.d + 1 FROM walk w
        JOIN ge e ON e.year = w.year AND e.quarter = w.quarter AND e.source = w.t WHERE w.d < 40""",
    "dist": "SELECT year, quarter, s, t, min(d) AS d FROM walk WHERE s <> t GROUP BY ALL",
    "spath": """SELECT year, quarter, s, t, d, 1 AS one FROM dist WHERE d = 1
      UNION ALL SELECT p.year, p.quarter, p.s, x.t, x.d, 1 FROM spath p
        JOIN ge e ON e.year = p.year AND e.quarter = p.quarter AND e.source = p.t
        JOIN dist x ON x.year = p.year AND x.quarter = p.quarter AND x.s = p.s AND x.t = e.target AND x.d = p.d + 1""",
    "sigma": "SELECT year, quarter, s, t, d, count(*) AS c FROM spath GROUP BY ALL",
    "betw": """SELECT a.year, a.quarter, a.t AS node, sum(a.c * b.c / x.c) AS total FROM sigma a
      JOIN sigma b ON b.year = a.year AND b.quarter = a.quarter AND b.s = a.t
      JOIN sigma x ON x.year = a.year AND x.quarter = a.quarter AND x.s = a.s AND x.t = b.t AND x.d = a.d + b.d
      GROUP BY ALL""",
    "cb": """SELECT g.year, g.quarter, g.node, CASE WHEN s.n > 2 AND b.total IS NOT NULL THEN b.total / ((s.n - 1) * (s.n - 2)) ELSE 0 END AS betweenness_centrality
      FROM gn g JOIN gs s USING (year, quarter) LEFT JOIN betw b USING (year, quarter, node)""",
    "cc_": """SELECT g.year, g.quarter, g.node, coalesce(r.k / r.total * r.k / (s.n - 1), 0) AS closeness_centrality FROM gn g JOIN gs s USING (year, quarter)
      LEFT JOIN (SELECT year, quarter, t AS node, count(*) AS k, sum(d) AS total FROM dist GROUP BY ALL) r USING (year, quarter, node)""",
    "cd": """SELECT g.year, g.quarter, g.node, CASE WHEN s.n = 1 THEN 1 ELSE g.k / (s.n - 1) END AS degree_centrality
      FROM (SELECT year, quarter, node, count(*) AS k FROM (SELECT year, quarter, source AS node FROM ge UNION ALL SELECT year, quarter, target FROM ge) GROUP BY ALL) g
      JOIN gs s USING (year, quarter)""",
    "ex": """SELECT g.year, g.quarter, g.node, coalesce(min(f.firm_pol), 0) AS exposure FROM gn g
      LEFT JOIN fo f ON f.firm_gvkey = g.node AND f.year = g.year AND f.quarter = g.quarter GROUP BY ALL""",
    "ee": """SELECT e.*, a.exposure AS own, b.exposure AS other FROM ge e JOIN ex a ON a.node = e.source AND a.year = e.year AND a.quarter = e.quarter
      JOIN ex b ON b.node = e.target AND b.year = e.year AND b.quarter = e.quarter""",
    "gp": f"SELECT * FROM ge WHERE year = {IN.GRAPH_PERIOD[0]} AND quarter = {IN.GRAPH_PERIOD[1]}",
    "ego": f"""SELECT node, min(hop) AS hop FROM (
        SELECT source AS node, 0 AS hop FROM gp WHERE source = {IN.CENTER} UNION ALL SELECT target, 0 FROM gp WHERE target = {IN.CENTER}
        UNION ALL SELECT target, 1 FROM gp WHERE source = {IN.CENTER}
        UNION ALL SELECT b.target, 2 FROM gp a JOIN gp b ON b.source = a.target WHERE a.source = {IN.CENTER}) GROUP BY node""",
    # market
    "ccm": "SELECT * FROM fx_ccm WHERE linktype IN (" + ", ".join(f"'{t}'" for t in LINK_TYPES) + ")",
    "ms": "SELECT *, year(date) AS year, quarter(date) AS quarter FROM fx_msf",
    "szq": "SELECT permno, year, quarter, arg_max(abs(prc) * shrout, date) AS size FROM ms WHERE prc IS NOT NULL AND shrout IS NOT NULL GROUP BY ALL",
    "szy": "SELECT permno, year, arg_max(abs(prc) * shrout, date) AS size FROM ms WHERE prc IS NOT NULL AND shrout IS NOT NULL GROUP BY ALL",
    "lpy": """SELECT DISTINCT a.firm_gvkey, b.lpermno AS firm_permno, a.* EXCLUDE (firm_gvkey) FROM nwa a LEFT JOIN ccm b ON a.firm_gvkey = b.gvkey
      AND (a.year >= year(b.linkdt) OR b.linkdt IS NULL) AND (a.year <= year(b.linkenddt) OR b.linkenddt IS NULL)""",
    "lpq": """SELECT DISTINCT a.firm_gvkey, b.lpermno AS firm_permno, a.* EXCLUDE (firm_gvkey) FROM
        (SELECT w.*, q.datadate FROM nwq w JOIN fx_fundq q ON q.gvkey = w.firm_gvkey AND year(q.datadate) = w.year AND month(q.datadate) = w.quarter * 3) a
      LEFT JOIN ccm b ON a.firm_gvkey = b.gvkey
      AND (a.datadate >= b.linkdt OR b.linkdt IS NULL) AND (a.datadate <= b.linkenddt OR b.linkenddt IS NULL)""",
    "fa": """SELECT * FROM (SELECT * REPLACE (coalesce(xad, 0) AS xad) FROM fx_funda) WHERE ceq IS NOT NULL AND capx IS NOT NULL AND sale IS NOT NULL
      AND "at" IS NOT NULL AND ni IS NOT NULL AND che IS NOT NULL AND rect IS NOT NULL AND invt IS NOT NULL AND ppent IS NOT NULL""",
    "ra": """SELECT gvkey, fyear, capx / nullif(sale, 0) AS capx, (che + rect + invt + ppent) / nullif("at", 0) AS tant, ni / nullif("at", 0) AS roa, xad AS adv_exp FROM fa""",
    "rq": """SELECT gvkey, year(datadate) AS year, quarter(datadate) AS quarter, capxy / nullif(saleq, 0) AS capx,
        (cheq + rectq + invtq + ppentq) / nullif(atq, 0) AS tant, niq / nullif(atq, 0) AS roa FROM fx_fundq""",
    "bmy": """SELECT b.firm_gvkey, s.year, a.ceq / nullif(s.size, 0) AS bm FROM szy s JOIN (SELECT DISTINCT firm_gvkey, firm_permno, year FROM lpy) b
        ON b.firm_permno = s.permno AND b.year = s.year
      JOIN fa a ON a.gvkey = b.firm_gvkey AND a.fyear = b.year WHERE s.size <> 0""",
    "bmq": """SELECT DISTINCT b.firm_gvkey, year(b.datadate) AS year, quarter(b.datadate) AS quarter, e.ceqq / nullif(m.mv, 0) AS bm
      FROM (SELECT DISTINCT firm_gvkey, firm_permno, datadate FROM lpq) b
      JOIN (SELECT gvkey, datadate, last_value(ceqq IGNORE NULLS) OVER (PARTITION BY gvkey ORDER BY datadate) AS ceqq FROM fx_fundq) e
        ON e.gvkey = b.firm_gvkey AND e.datadate = b.datadate
      JOIN (SELECT permno, year, arg_max(size, quarter) AS mv FROM szq GROUP BY ALL) m ON m.permno = b.firm_permno AND m.year = year(b.datadate)
      WHERE m.mv <> 0 AND e.ceqq IS NOT NULL""",
    "rty": "SELECT permno, year, lag(g) OVER (PARTITION BY permno ORDER BY year) AS ret FROM (SELECT permno, year, coalesce(product(1 + ret), 1) AS g FROM ms GROUP BY ALL)",
    "rtq": """SELECT permno, year, quarter, g * g1 * g2 * g3 AS ret FROM (SELECT *, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2, lag(g, 3) OVER w AS g3
      FROM (SELECT permno, year, quarter, coalesce(product(1 + ret), 1) AS g FROM ms GROUP BY ALL) WINDOW w AS (PARTITION BY permno ORDER BY year, quarter)) WHERE g3 IS NOT NULL""",
    "voq": "SELECT permno, year, quarter, coalesce(sum(vol), 0) AS vol FROM ms GROUP BY ALL",
    "vlq": """SELECT a.permno, a.year, a.quarter, b.vol FROM voq a LEFT JOIN voq b ON b.permno = a.permno
      AND b.year = CASE WHEN a.quarter <= 2 THEN a.year - 1 ELSE a.year END
      AND b.quarter = CASE WHEN a.quarter <= 2 THEN a.quarter + 2 ELSE a.quarter - 2 END""",
    "vly": """SELECT * FROM (SELECT permno, year, lag(v, 2) OVER (PARTITION BY permno ORDER BY year) AS vol
      FROM (SELECT permno, year, coalesce(sum(vol), 0) AS v FROM ms GROUP BY ALL)) WHERE vol IS NOT NULL""",
    "adq": """SELECT * FROM (SELECT q.gvkey, year(q.datadate) AS year, quarter(q.datadate) AS quarter,
        last_value(a.xad IGNORE NULLS) OVER (PARTITION BY q.gvkey ORDER BY q.datadate, a.xad ROWS UNBOUNDED PRECEDING) AS adv_exp
      FROM fx_fundq q LEFT JOIN fx_funda a ON a.gvkey = q.gvkey AND a.xad IS NOT NULL AND year(a.datadate) = year(q.datadate)
        AND quarter(a.datadate) = quarter(q.datadate)) WHERE adv_exp IS NOT NULL""",
    "cpy": _compound("year"),
    "cpq": _compound("year, quarter"),
    "exy": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {n} AS horizon, permno, year, lead(ret - port_ret, {n}) OVER (PARTITION BY permno ORDER BY year) AS excess_return FROM cpy"
        for n in YEAR_HORIZONS
    ) + ") WHERE excess_return IS NOT NULL",
    "exq": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {n} AS horizon, permno, year, quarter, lead(ret - port_ret, {n}) OVER (PARTITION BY permno ORDER BY year, quarter) AS excess_return FROM cpq"
        for n in QUARTER_HORIZONS
    ) + ") WHERE excess_return IS NOT NULL",
    "exc": "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {n} AS horizon, permno, year, quarter, CASE WHEN count(*) OVER w = {n} THEN product(ret) OVER w - product(port_ret) OVER w END AS excess_return
        FROM cpq WINDOW w AS (PARTITION BY permno ORDER BY year, quarter ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"""
        for n in QUARTER_HORIZONS
    ) + ") WHERE excess_return IS NOT NULL",
    # balanced account panel for the regressions
    "ap": """SELECT gvkey AS f, year(datadate) * 4 + quarter(datadate) - 1 AS t, niq / atq * 100 AS y0, ln(saleq) AS a0, capxy / saleq * 100 AS b0 FROM fx_fundq""",
    "ah": "SELECT 'roa' AS model, f, t, y0, a0, b0 FROM ap"
    + "".join(
        f" UNION ALL SELECT 'h{n}', f, t, lead(y0, {n}) OVER (PARTITION BY f ORDER BY t), a0, b0 FROM ap"
        for n in YEAR_HORIZONS
    ),
    "am": "SELECT * FROM ah WHERE y0 IS NOT NULL",
    "ad": "SELECT model, f, t, y0, " + ", ".join(
        f"{c}0 - avg({c}0) OVER (PARTITION BY model, f) - avg({c}0) OVER (PARTITION BY model, t) + avg({c}0) OVER (PARTITION BY model) AS {c}"
        for c in "yab"
    ) + " FROM am",
    "ag": """SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ca, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS cb
      FROM (SELECT model, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy,
              count(*) AS n, count(DISTINCT f) AS nf, count(DISTINCT t) AS nt, var_pop(y0) * count(*) AS tss FROM ad GROUP BY model)""",
    "ar": "SELECT d.*, (d.y - g.ca * d.a - g.cb * d.b) AS e FROM ad d JOIN ag g USING (model)",
    "ame": """SELECT model, sum(k * aa) AS maa, sum(k * ab) AS mab, sum(k * bb) AS mbb FROM (
        SELECT model, count(*) / (count(*) - 1) AS k, sum(sa * sa) AS aa, sum(sa * sb) AS ab, sum(sb * sb) AS bb FROM (SELECT model, f, sum(a * e) AS sa, sum(b * e) AS sb FROM ar GROUP BY ALL) GROUP BY model
        UNION ALL SELECT model, count(*) / (count(*) - 1), sum(sa * sa), sum(sa * sb), sum(sb * sb) FROM (SELECT model, t, sum(a * e) AS sa, sum(b * e) AS sb FROM ar GROUP BY ALL) GROUP BY model
        UNION ALL SELECT model, -count(*) / (count(*) - 1), sum(sa * sa), sum(sa * sb), sum(sb * sb) FROM (SELECT model, f, t, sum(a * e) AS sa, sum(b * e) AS sb FROM ar GROUP BY ALL) GROUP BY model) GROUP BY model""",
    "av": """SELECT g.*, s.ssr, (g.n - 1) / (g.n - (2 + g.nf + g.nt - 1)) * (g.bb * g.bb * m.maa - 2 * g.bb * g.ab * m.mab + g.ab * g.ab * m.mbb) / (g.det * g.det) AS va,
        (g.n - 1) / (g.n - (2 + g.nf + g.nt - 1)) * (g.ab * g.ab * m.maa - 2 * g.ab * g.aa * m.mab + g.aa * g.aa * m.mbb) / (g.det * g.det) AS vb
      FROM ag g JOIN ame m USING (model) JOIN (SELECT model, sum(e * e) AS ssr FROM ar GROUP BY ALL) s USING (model)""",
    "at_": """SELECT model, 'log_sale' AS term, ca AS estimate, sqrt(va) AS se, ca / sqrt(va) AS t, n, nf AS units, nt AS periods, 1 - ssr / tss AS r2, 1 - ssr / yy AS r2_within FROM av
      UNION ALL SELECT model, 'capx', cb, sqrt(vb), cb / sqrt(vb), n, nf, nt, 1 - ssr / tss, 1 - ssr / yy FROM av""",
}
# Statements that bring several named steps of their own.
BUNDLES = {
    "nm_link": _name_scores(("coname", "lbase"), ("n", "pnames")),
    "nm_part": _name_scores(("name_a", "nb"), ("name_b", "nb")),
}
CTES["nb"] = f"SELECT id, {_base('name_a')} AS name_a, {_base('name_b')} AS name_b FROM fx_names"


def _scores_sql(words: str, columns: str) -> str:
    def n(tag: str) -> str:
        return f"count(*) FILTER (tag = '{tag}')"

    return f"""
      win AS (SELECT transcriptid, w, unnest(range(11, greatest(len(w) - 10, 11))) AS c FROM {words}),
      hit AS (SELECT transcriptid, c, weight, list_distinct(w[c - 10:c + 11]) AS v FROM win JOIN big ON big.term = w[c] || ' ' || w[c + 1]),
      hw AS (SELECT transcriptid, c, weight, unnest(v) AS x FROM hit),
      hn AS (SELECT transcriptid, c, weight, {n("risk")} AS r, {n("positive")} AS p, {n("negative")} AS g FROM hw
        LEFT JOIN lex ON lex.term = hw.x GROUP BY ALL),
      con AS (SELECT transcriptid, sum(weight) AS Pol, sum(CASE WHEN r > 0 THEN weight ELSE 0 END) AS PRisk,
          sum(weight * (p - g)) AS PSentiment FROM hn GROUP BY ALL),
      uw AS (SELECT transcriptid, unnest(w) AS x FROM {words}),
      un AS (SELECT transcriptid, {n("risk")} AS Risk, {n("positive")} - {n("negative")} AS Sentiment, {n("covid")} AS Covid
        FROM uw JOIN lex ON lex.term = uw.x GROUP BY ALL),
      allsc AS (SELECT t.transcriptid, len(t.w) AS total_words, coalesce(u.Risk, 0) AS Risk, coalesce(u.Sentiment, 0) AS Sentiment,
          coalesce(u.Covid, 0) AS Covid, coalesce(c.Pol, 0) AS Pol, coalesce(c.PRisk, 0) AS PRisk, coalesce(c.PSentiment, 0) AS PSentiment
        FROM {words} t LEFT JOIN un u USING (transcriptid) LEFT JOIN con c USING (transcriptid))
      SELECT {columns} FROM allsc"""


_SCALED = "transcriptid, total_words, " + ", ".join(
    f"CASE WHEN total_words > 0 THEN {c} * 100000.0 / total_words END AS {c}"
    for c in ("Risk", "Sentiment", "Covid", "Pol", "PRisk", "PSentiment")
)
_SIDE = "SELECT * FROM {t} WHERE side = '{s}'"
_SHARES = """SELECT side, year, quarter, {props}, count(DISTINCT firm_gvkey) AS firm_count FROM {t} GROUP BY side, year, quarter"""


def _props(suffix: str) -> str:
    return ", ".join(
        f"count(DISTINCT CASE WHEN larger_{m}{suffix} = 1 THEN firm_gvkey END) / count(DISTINCT firm_gvkey) AS {m}_prop"
        for m in METRICS
    )


SQL: dict[str, str] = {
    "scan_csv_roundtrip": "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderstatus FROM orders",
    "scan_pruned": "SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem",
    "scan_date_range": "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-31' AND TIMESTAMP '1998-06-30'",
    "scan_linktype_in": "SELECT * FROM ccm",
    "lexicon_sentiment": """SELECT w AS term, 'positive' AS tag FROM dic WHERE length(w) % 5 = 0 UNION ALL SELECT w, 'negative' FROM dic WHERE length(w) % 7 = 0""",
    "lexicon_risk": """lt AS (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS term FROM documents)
      SELECT DISTINCT term, 'risk' AS tag FROM lt WHERE term <> ''""",
    "lexicon_bigrams": f"""cw AS (SELECT {_words('text')} AS w FROM conversations),
      cp AS (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM cw)
      SELECT term, count(*) * 0.125 AS weight FROM cp GROUP BY term""",
    "lexicon_covid": f"""cw AS (SELECT unnest({_words('text')}) AS x FROM (SELECT text FROM conversations UNION ALL SELECT text FROM documents))
      SELECT l.term, count(c.x) AS n FROM (SELECT DISTINCT term FROM lex WHERE tag = 'covid' AND term <> 'is') l LEFT JOIN cw c ON c.x = l.term GROUP BY l.term""",
    "head_rows": "SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_quantity AS quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 5",
    "distinct_rows": "SELECT gvkey, quarter(date) AS quarter, Covid_Exposure AS covid FROM fx_pol GROUP BY ALL",
    "dropna_any": "SELECT * FROM fx_pol WHERE Risk IS NOT NULL AND Covid_Exposure IS NOT NULL",
    "relation_clean": "SELECT * FROM rel",
    "calendar_case": """SELECT *, q_month AS qm2 FROM (SELECT d, year(d) AS year, month(d) AS month, quarter(d) AS quarter,
        CASE WHEN month(d) <= 3 THEN 1 WHEN month(d) <= 6 THEN 2 WHEN month(d) <= 9 THEN 3 ELSE 4 END AS q_case, quarter(d) * 3 AS q_month,
        CASE quarter(d) WHEN 1 THEN make_date(year(d), 3, 31) WHEN 2 THEN make_date(year(d), 6, 30) WHEN 3 THEN make_date(year(d), 9, 30) ELSE make_date(year(d), 12, 31) END AS q_end,
        concat(year(d), 'Q', quarter(d)) AS label,
        concat(year(d), CASE quarter(d) WHEN 1 THEN '-03-31' WHEN 2 THEN '-06-30' WHEN 3 THEN '-09-30' ELSE '-12-31' END) AS date_label,
        CASE WHEN quarter(d) <= 2 THEN year(d) - 1 ELSE year(d) END AS back_year, CASE WHEN quarter(d) <= 2 THEN quarter(d) + 2 ELSE quarter(d) - 2 END AS back_quarter
      FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))""",
    "firm_quarter_grid": "SELECT s.source_company_id, q.year, q.quarter, q.date FROM (SELECT DISTINCT source_company_id FROM fx_relation) s, qe q",
    "panel_expand": "SELECT * FROM pan",
    "panel_filter_any_id": "SELECT * FROM pid",
    "link_cascade_split": """SELECT route, rel_type, count(*) AS n FROM (SELECT 'cusip' AS route, rel_type FROM pcusip UNION ALL SELECT 'isin', rel_type FROM pisin
      UNION ALL SELECT 'name', rel_type FROM pname UNION ALL SELECT 'none', rel_type FROM pnone) GROUP BY ALL""",
    "link_unrouted": "SELECT * FROM pnone",
    "link_cusip": "SELECT * FROM lcusip",
    "link_isin": "SELECT * FROM lisin",
    "linktable_semi": "SELECT * FROM lsemi",
    "link_name": "{nm_link} SELECT * FROM lname",
    "links_union": """{nm_link} SELECT * FROM lcusip WHERE SOURCE_gvkey IS NOT NULL AND TARGET_gvkey IS NOT NULL
      UNION SELECT * FROM lisin WHERE SOURCE_gvkey IS NOT NULL AND TARGET_gvkey IS NOT NULL
      UNION SELECT * FROM lname WHERE SOURCE_gvkey IS NOT NULL AND TARGET_gvkey IS NOT NULL""",
    "name_normalise": "SELECT id, name_a AS base_a, name_b AS base_b FROM nb",
    "name_match_pairs": "{nm_part} SELECT * FROM nm WHERE score >= 90",
    "name_match_topk": "{nm_part} SELECT *, row_number() OVER (PARTITION BY name_a ORDER BY score DESC, name_b) AS rank FROM nm WHERE score >= 90 QUALIFY rank <= 5",
    "name_match_best": "{nm_part} SELECT *, row_number() OVER (PARTITION BY name_a ORDER BY score DESC, name_b) AS rank FROM nm WHERE score >= 90 QUALIFY rank = 1",
    "text_clean": f"SELECT transcriptid, ord, {_clean('componenttext')} AS cleaned, len({_words('componenttext')}) AS n_words FROM fx_transcripts",
    "transcript_concat": "SELECT transcriptid, string_agg(componenttext, ' ' ORDER BY ord) AS text FROM fx_transcripts GROUP BY transcriptid",
    "bigram_counts": """tp AS (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM tw)
      SELECT bigram, count(*) AS n FROM tp GROUP BY bigram""",
    "bigram_windows": """win AS (SELECT transcriptid, w, unnest(range(11, greatest(len(w) - 10, 11))) AS c FROM tw)
      SELECT transcriptid, c - 1 AS pos, w[c] || ' ' || w[c + 1] AS bigram, array_to_string(w[c - 10:c + 11], ' ') AS "window" FROM win""",
    "transcript_unconditional": _scores_sql("tw", "*"),
    "transcript_conditional": _scores_sql("tw", "*"),
    "transcript_scores": _scores_sql("tw", _SCALED),
    "document_scores": _scores_sql("dw", _SCALED),
    "disclosed_links": "SELECT * FROM dl",
    "score_panel": "SELECT * FROM sp",
    "score_attach": "SELECT * FROM fs",
    "sales_totals": "SELECT * FROM st",
    "value_weighted_links": "SELECT * FROM vw",
    "partner_larger_flags": "SELECT * FROM fl",
    "partner_larger_props": _SHARES.format(props=_props(""), t="fl"),
    "partner_larger_props_weighted": _SHARES.format(props=_props("_w"), t="fl"),
    "partner_larger_props_long": "rl AS (SELECT *, "
    + ", ".join(f"{_larger(f'partner_{m}', f'firm_{m}')} AS larger_{m}" for m in METRICS)
    + " FROM fs WHERE firm_pol IS NOT NULL AND firm_covid IS NOT NULL AND firm_cc IS NOT NULL), rs AS ("
    + _SHARES.format(props=_props(""), t="rl") + ") "
    + " UNION ALL ".join(
        f"SELECT 'larger_' || side || '_{m}_prop' AS metric, year, quarter, {m}_prop AS prop, firm_count FROM rs" for m in METRICS
    ),
    "firm_universe": "SELECT DISTINCT firm_gvkey, year, quarter, firm_pol, firm_covid, firm_cc FROM fo",
    "firm_meta": "SELECT DISTINCT u.firm_gvkey, u.year, u.quarter, s.partner_gvkey AS supplier_gvkey, c.partner_gvkey AS customer_gvkey, "
    + ", ".join(f"u.firm_{m} + s.partner_{m}_weighted + c.partner_{m}_weighted AS sc_{m}" for m in METRICS)
    + """ FROM (SELECT DISTINCT firm_gvkey, year, quarter, firm_pol, firm_covid, firm_cc FROM fl) u
      LEFT JOIN fl s ON s.side = 'supplier' AND s.firm_gvkey = u.firm_gvkey AND s.year = u.year AND s.quarter = u.quarter
      LEFT JOIN fl c ON c.side = 'customer' AND c.firm_gvkey = u.firm_gvkey AND c.year = u.year AND c.quarter = u.quarter""",
    "firm_lookup": "SELECT * FROM fs WHERE firm_gvkey = 1004",
    "degree2_ew_paths": "SELECT l.side, l.firm_gvkey, l.year, l.quarter, d.pol, d.covid, d.cc FROM dc l JOIN e1 d ON d.side = l.side AND d.firm_gvkey = l.partner_gvkey AND d.year = l.year AND d.quarter = l.quarter",
    "degree2_vw_paths": "SELECT l.side, l.firm_gvkey, l.year, l.quarter, d.pol, d.covid, d.cc FROM dc l JOIN v1 d ON d.side = l.side AND d.firm_gvkey = l.partner_gvkey AND d.year = l.year AND d.quarter = l.quarter",
    "firm_degree_table": "SELECT * FROM ft",
    "coverage_counts": "SELECT count(DISTINCT firm_gvkey) AS firms, count(DISTINCT firm_gvkey) FILTER (two) AS firms_two_degrees, count(DISTINCT firm_gvkey) FILTER (two AND three) AS firms_three_degrees FROM cov",
    "coverage_by_year": "SELECT year, count(*) AS n FROM cov WHERE two AND three GROUP BY year",
    "degree_links": "SELECT * FROM dlk",
    "link_cycles": "SELECT * FROM dlk WHERE firm_gvkey = partner_gvkey",
    "avg_partner_count": """SELECT s.side, g.degree, avg(coalesce(c.n, 0)) AS avg_partners FROM (SELECT DISTINCT firm_gvkey, year, quarter FROM ck) u,
      (VALUES ('supplier'), ('customer')) s(side), range(1, 4) g(degree)
      LEFT JOIN (SELECT side, degree, firm_gvkey, year, quarter, count(DISTINCT partner_gvkey) AS n FROM dlk GROUP BY ALL) c
        ON c.side = s.side AND c.degree = g.degree AND c.firm_gvkey = u.firm_gvkey AND c.year = u.year AND c.quarter = u.quarter GROUP BY ALL""",
    "esg_score_prep": "SELECT * FROM esg",
    "env_score_prep": "SELECT * FROM env",
    "esg_firm_ffill": f"""SELECT firm_gvkey, year, quarter, firm_pol, degree1_supplier_pol,
        last_value(v IGNORE NULLS) OVER (PARTITION BY firm_gvkey ORDER BY year, quarter, v NULLS FIRST {FILL}) AS scorevalue
      FROM (SELECT f.*, e.scorevalue AS v FROM ft f LEFT JOIN esg e ON e.gvkey = f.firm_gvkey AND e.year = f.year AND e.quarter = f.quarter)""",
    "coverage_with_esg_score": f"""ff AS (SELECT f.*, last_value(v IGNORE NULLS) OVER (PARTITION BY firm_gvkey ORDER BY year, quarter, v NULLS FIRST {FILL}) AS filled
        FROM (SELECT f.*, e.scorevalue AS v FROM ft f LEFT JOIN esg e ON e.gvkey = f.firm_gvkey AND e.year = f.year AND e.quarter = f.quarter) f),
      fk AS (SELECT * FROM ff WHERE filled IS NOT NULL AND """
    + " AND ".join(f"(degree{d}_supplier_pol IS NOT NULL OR degree{d}_customer_pol IS NOT NULL)" for d in (1, 2, 3))
    + """) SELECT year, count(DISTINCT firm_gvkey) AS firms, count(*) AS n FROM fk GROUP BY year
      UNION ALL SELECT NULL, count(DISTINCT firm_gvkey), count(*) FROM fk""",
    "decline_table_counts": "SELECT side, degree, count(DISTINCT firm_gvkey) AS firms, count(DISTINCT partner_gvkey) AS partners FROM edq GROUP BY side, degree",
    "firm_first_degree_table": "SELECT u.firm_gvkey, u.year, u.quarter, "
    + ", ".join(f"{w}_{s[0]}.{m} AS degree1_{w}_{s}_{m}" for w in ("ew", "vw") for s in ("supplier", "customer") for m in METRICS)
    + " FROM (SELECT DISTINCT firm_gvkey, year, quarter, firm_pol, firm_covid, firm_cc FROM dc) u "
    + " ".join(
        f"LEFT JOIN {t} {w}_{s[0]} ON {w}_{s[0]}.side = '{s}' AND {w}_{s[0]}.firm_gvkey = u.firm_gvkey AND {w}_{s[0]}.year = u.year AND {w}_{s[0]}.quarter = u.quarter"
        for w, t in (("ew", "e1"), ("vw", "v1"))
        for s in ("supplier", "customer")
    ),
    "ffill_panel": f"SELECT gvkey, year, quarter, covid, last_value(covid IGNORE NULLS) OVER (PARTITION BY gvkey ORDER BY year, quarter {FILL}) AS covid_filled FROM sp",
    "esg_decline_quarterly": "SELECT * FROM edq",
    "env_decline_quarterly": "SELECT * FROM ndq",
    "env_decline_annual": "SELECT * FROM nda",
    "decline_rate": "SELECT *, sum(decline) OVER (PARTITION BY side, degree, firm_gvkey, year, quarter) / count(*) OVER (PARTITION BY side, degree, firm_gvkey, year, quarter) AS decline_rate FROM edq",
    "decline_rate_summary": """SELECT side, degree, avg(m) AS mean, avg(s) AS std, avg(a) AS q25, avg(b) AS q75, avg(c) AS median FROM (
        SELECT side, degree, year, quarter, avg(r) AS m, stddev_samp(r) AS s, quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.75) AS b, median(r) AS c
        FROM (SELECT side, degree, firm_gvkey, year, quarter, (sum(decline) / count(*))::DOUBLE AS r FROM edq GROUP BY ALL) GROUP BY side, degree, year, quarter)
      GROUP BY side, degree""",
    "decline_firm_flag": "SELECT * FROM nfq",
    "decline_flag_share": "SELECT side, degree, avg(f) AS share FROM (SELECT side, degree, firm_gvkey, year, quarter, CASE WHEN avg(decline) > 0.5 THEN 1 ELSE 0 END AS f FROM edq GROUP BY ALL) GROUP BY ALL",
    "env_score_wide": "SELECT * FROM nwq",
    "env_score_wide_year": "SELECT * FROM nwa",
    "graph_edges": "SELECT * FROM ge",
    "graph_node_count": "SELECT count(DISTINCT node) AS n_nodes FROM gn",
    "degree_centrality": "SELECT * FROM cd",
    "closeness_centrality": "SELECT * FROM cc_",
    "betweenness_centrality": "SELECT * FROM cb",
    "centrality_table": "SELECT * FROM cd JOIN cb USING (year, quarter, node) JOIN cc_ USING (year, quarter, node)",
    "node_exposure": "SELECT * FROM ex",
    "nodes_majority_lower": "SELECT DISTINCT source AS node FROM (SELECT year, quarter, source FROM ee GROUP BY ALL HAVING count(*) FILTER (other <= own) / count(*) > 0.5)",
    "nodes_all_higher": f"SELECT source AS node FROM ee WHERE year = {IN.GRAPH_PERIOD[0]} AND quarter = {IN.GRAPH_PERIOD[1]} GROUP BY source HAVING count(*) FILTER (other >= own) = count(*)",
    "ego_network": "SELECT * FROM gp WHERE source IN (SELECT node FROM ego) AND target IN (SELECT node FROM ego)",
    "ego_nodes": f"SELECT e.node, e.hop, x.exposure FROM ego e JOIN ex x ON x.node = e.node AND x.year = {IN.GRAPH_PERIOD[0]} AND x.quarter = {IN.GRAPH_PERIOD[1]}",
    "link_permno_year": "SELECT * FROM lpy",
    "link_permno_date": "SELECT * FROM lpq",
    "ctl_size": "SELECT * FROM szq",
    "ctl_size_year": "SELECT * FROM szy",
    "ctl_bm_year": "SELECT * FROM bmy",
    "ctl_bm_quarter": "SELECT * FROM bmq",
    "ctl_return_year": "SELECT * FROM rty",
    "ctl_return_quarter": "SELECT * FROM rtq",
    "ctl_price_year": """SELECT * FROM (SELECT permno, year, lag(p, 2) OVER (PARTITION BY permno ORDER BY year) AS prc
      FROM (SELECT permno, year, abs(arg_max(prc, date)) AS p FROM ms WHERE prc IS NOT NULL GROUP BY ALL)) WHERE prc IS NOT NULL""",
    "ctl_price_lag2q": """lagd AS (SELECT permno, date, year, quarter, CAST(date_trunc('quarter', date - INTERVAL 6 MONTH) + INTERVAL 3 MONTH AS DATE) - 1 AS e FROM ms),
      lagb AS (SELECT *, e - CASE dayofweek(e) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS b FROM lagd),
      lagp AS (SELECT l.permno, l.year, l.quarter, l.date, p.prc, row_number() OVER (PARTITION BY l.permno, l.year, l.quarter ORDER BY l.date DESC) AS r
        FROM lagb l LEFT JOIN fx_msf p ON p.permno = l.permno AND p.date = l.b)
      SELECT permno, year, quarter, abs(prc) AS prc FROM lagp WHERE r = 1 AND prc IS NOT NULL""",
    "ctl_volume_year": "SELECT * FROM vly",
    "ctl_volume_lag2q": "SELECT * FROM vlq",
    "ctl_ratios": "SELECT * FROM ra",
    "ctl_ratios_quarter": "SELECT * FROM rq",
    "ctl_adv_quarter": "SELECT * FROM adq",
    "compound_returns": "SELECT * FROM cpq",
    "excess_return_lead_year": "SELECT * FROM exy",
    "excess_return_lead_quarter": "SELECT * FROM exq",
    "excess_return_cumulative": "SELECT * FROM exc",
    "regression_sample": """SELECT DISTINCT e.*, x.excess_return, s.size, b.bm, r.ret, v.vol, a.capx, a.tant, a.roa, a.adv_exp FROM lpy e
      JOIN exy x ON x.horizon = 1 AND x.permno = e.firm_permno AND x.year = e.year JOIN szy s ON s.permno = e.firm_permno AND s.year = e.year
      JOIN bmy b ON b.firm_gvkey = e.firm_gvkey AND b.year = e.year JOIN rty r ON r.permno = e.firm_permno AND r.year = e.year
      JOIN vly v ON v.permno = e.firm_permno AND v.year = e.year JOIN ra a ON a.gvkey = e.firm_gvkey AND a.fyear = e.year
      WHERE s.size > 0 AND b.bm > 0 AND r.ret > 0 AND v.vol > 0""",
    "regression_sample_quarter": """SELECT DISTINCT e.*, x.excess_return, s.size, b.bm, r.ret, v.vol, a.capx, a.tant, a.roa, coalesce(d.adv_exp, 0) AS adv_exp FROM lpq e
      JOIN exq x ON x.horizon = 1 AND x.permno = e.firm_permno AND x.year = e.year AND x.quarter = e.quarter
      JOIN szq s ON s.permno = e.firm_permno AND s.year = e.year AND s.quarter = e.quarter
      JOIN bmq b ON b.firm_gvkey = e.firm_gvkey AND b.year = e.year AND b.quarter = e.quarter
      JOIN rtq r ON r.permno = e.firm_permno AND r.year = e.year AND r.quarter = e.quarter
      JOIN vlq v ON v.permno = e.firm_permno AND v.year = e.year AND v.quarter = e.quarter
      JOIN rq a ON a.gvkey = e.firm_gvkey AND a.year = e.year AND a.quarter = e.quarter
      LEFT JOIN adq d ON d.gvkey = e.firm_gvkey AND d.year = e.year AND d.quarter = e.quarter
      WHERE s.size > 0 AND b.bm > 0 AND r.ret > 0 AND v.vol > 0""",
    "felm_coefficients": "SELECT * FROM at_ WHERE model = 'roa'",
    "felm_clustered_se": "SELECT * FROM at_ WHERE model = 'roa'",
    "felm_model_table": "SELECT * FROM at_ WHERE model <> 'roa'",
}
for _d, _t in (("degree1_ew", "d1"), ("degree2_ew", "d2"), ("degree3_ew", "d3"), ("degree1_vw", "v1")):
    for _s in ("supplier", "customer"):
        SQL[f"{_d}_{_s}"] = _SIDE.format(t=_t, s=_s)


def _needed(sql: str) -> list[str]:
    """Named steps a statement uses, in order of definition."""
    found: list[str] = []

    def visit(text: str) -> None:
        # A table stands after FROM, JOIN or a comma; a name followed by "." is an alias.
        for name in re.findall(r"(?:\bFROM|\bJOIN|,)\s+([a-z_][a-z0-9_]*)(?![\w.(])", text):
            if name in CTES and name not in found and name not in visiting:
                visiting.add(name)
                visit(CTES[name])
                found.append(name)

    visiting: set[str] = set()
    visit(sql)
    return found


def _typed(spec: str) -> str:
    kinds = {"l": "BIGINT", "s": "VARCHAR", "t": "DATE"}
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        quoted = f'"{name}"'
        if kind == "d":
            cols.append(f"round(CAST({quoted} AS DOUBLE) + 1e-9, 6) + 0.0 AS {quoted}")
        else:
            cols.append(f"CAST({quoted} AS {kinds[kind]}) AS {quoted}")
    return ", ".join(cols)


def statement(name: str) -> str:
    """Complete SQL of one query, with the named steps it needs."""
    body = SQL[name].strip()
    if "{nm_link}" not in body and "lname" in _needed(body):
        body = "{nm_link} " + body
    after: list[str] = []
    for bundle, text in BUNDLES.items():
        marker = "{" + bundle + "}"
        if marker in body:
            own = _needed(text)
            body = body.replace(marker, "").strip()
            rest = [n for n in _needed(body) if n not in own]
            first = [f"{n} AS ({CTES[n]})" for n in own]
            after = first + [text.strip()] + [f"{n} AS ({CTES[n]})" for n in rest]
    if not after:
        after = [f"{n} AS ({CTES[n]})" for n in _needed(body)]
    # A body may open with steps of its own before its final SELECT.
    if not body.upper().startswith("SELECT"):
        cut = _final_select(body)
        after.append(body[:cut].rstrip())
        body = body[cut:]
    head = "WITH RECURSIVE " + ",\n".join(after) + "\n" if after else ""
    return f"{head}SELECT {_typed(QUERIES[name][0])} FROM ({body}) AS final"


def _final_select(body: str) -> int:
    """Offset of the first SELECT outside parentheses."""
    depth = 0
    for m in re.finditer(r"[()]|\bSELECT\b", body):
        if m.group() == "(":
            depth += 1
        elif m.group() == ")":
            depth -= 1
        elif depth == 0:
            return m.start()
    raise ValueError("no final SELECT")


def oracle_statements() -> dict[str, str]:
    return {name: statement(name) for name in QUERIES if name in SQL}
