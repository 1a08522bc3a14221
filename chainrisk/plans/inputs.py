"""Input tables of a data directory and the stand-in tables derived from them.

The stand-ins have the columns the operators read.  Each is one SQL statement
over the directory's Parquet tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainrisk.functions.text import bigrams_of, words_of
from chainrisk.operators.panel import identified_panel, panel_expand
from chainrisk.sources.lexicons import bigram_lexicon, covid_lexicon, risk_lexicon, sentiment_lexicon

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Parameters of the study period covered by the stand-ins.
FIRST_YEAR, LAST_YEAR, MIN_YEAR = 1995, 2001, 1996
OPEN_END = "2001-12-31"
GRAPH_PERIOD = (1998, 4)
CENTER = 1000

STANDINS: dict[str, str] = {
    # One relation per supplier, customer, line status and year: every pair that trades.
    # A customer is the firm of its number modulo the suppliers, so that partners have partners.
    "fx_relation": """
        SELECT source_company_id, target_company_id, rel_type, start_, end_,
          CASE WHEN k%7<>0 THEN concat('Firm ',source_company_id,' Inc.') END AS SOURCE_name,
          concat('Firm ',target_company_id,' Inc.') AS TARGET_name,
          CASE WHEN k%4 IN (0,2) THEN concat(lpad(CAST(source_company_id AS STRING),8,'0'),'7') END AS SOURCE_cusip,
          CASE WHEN k%4=0 THEN concat(lpad(CAST(target_company_id AS STRING),8,'0'),'7') END AS TARGET_cusip,
          CASE WHEN k%4=1 THEN concat('US',source_company_id) END AS SOURCE_isin,
          CASE WHEN k%4 IN (1,2) THEN concat('US',target_company_id) END AS TARGET_isin
        FROM (SELECT source_company_id, target_company_id, rel_type, source_company_id + target_company_id AS k, min(day) AS start_,
                CASE WHEN (source_company_id + target_company_id)%97=0 THEN DATE '4000-01-01'
                     ELSE CAST(max(day) + INTERVAL '60' DAY AS DATE) END AS end_
              FROM (SELECT l_suppkey AS source_company_id, o_custkey % (SELECT count(*) FROM supplier) AS target_company_id,
                      CASE WHEN l_linestatus='F' THEN 'SUPPLIER' ELSE 'CUSTOMER' END AS rel_type, CAST(l_shipdate AS DATE) AS day
                    FROM lineitem JOIN orders ON l_orderkey=o_orderkey) t
              GROUP BY source_company_id, target_company_id, rel_type, year(day)) r
        WHERE source_company_id<>target_company_id""",
    "fx_link": """
        SELECT s_suppkey+1000 AS gvkey, lpad(CAST(s_suppkey AS STRING),8,'0') AS CUSIPH, s_suppkey+5000 AS cik,
          concat('Firm ',s_suppkey,' Inc.') AS coname, DATE '1995-01-01' AS FNDATE,
          CASE WHEN s_suppkey%7=0 THEN DATE '1998-12-31' ELSE DATE '2002-12-31' END AS LNDATE FROM supplier""",
    "fx_dir": """
        SELECT concat('US',s_suppkey) AS isin, s_suppkey+5000 AS cikcode FROM supplier WHERE s_suppkey%11<>0""",
    "fx_pol": """
        SELECT o_custkey % (SELECT count(*) FROM supplier) + 1000 AS gvkey, CAST(o_orderdate AS DATE) AS date,
          o_totalprice/1000 AS Risk,
          CASE WHEN o_orderstatus='P' THEN NULL ELSE CAST(o_orderkey%10 AS DOUBLE) END AS Covid_Exposure
        FROM orders""",
    "fx_cc": """
        SELECT l_suppkey+1000 AS gvkey, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter, avg(l_discount) AS cc_expo_ew
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)""",
    # Sales of a supplier to each of its customers a year, over all line items.
    "fx_disclosed": """
        SELECT l_suppkey+1000 AS GVKEY1, customer_no + 1000 AS GVKEY2, y, sum(l_extendedprice)-10000 AS SALECS
        FROM (SELECT l_suppkey, o_custkey % (SELECT count(*) FROM supplier) AS customer_no, year(o_orderdate) AS y, l_extendedprice
              FROM lineitem JOIN orders ON l_orderkey=o_orderkey) s
        GROUP BY l_suppkey, customer_no, y""",
    # One score per institution, quarter and line number, over all line items.
    "fx_trucost": """
        SELECT l_suppkey+9000 AS institutionid, max(CAST(l_shipdate AS DATE)) AS scoredate, year(l_shipdate) AS assessmentyear,
          CAST(sum(CAST(l_quantity AS BIGINT)) % 100 AS DOUBLE) AS scorevalue,
          CASE WHEN l_linenumber%2=0 THEN 'S&P Global ESG Score' ELSE 'Dimension' END AS scoretype,
          CASE WHEN l_linenumber=7 THEN 'Reported' ELSE 'Modeled' END AS csascoretypename,
          'Environmental Dimension' AS dimensionname, 'Environmental Dimension' AS aspectname,
          CASE WHEN l_linenumber=5 THEN 2 ELSE 1 END AS mostrecentsequence
        FROM lineitem GROUP BY l_suppkey, l_linenumber, year(l_shipdate), quarter(l_shipdate)""",
    "fx_inst": """
        SELECT s_suppkey+9000 AS institutionid, s_suppkey+1000 AS gvkey FROM supplier WHERE s_suppkey%13<>0""",
    "fx_msf": """
        SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS date,
          CASE WHEN count(*)%5=0 THEN -1 ELSE 1 END * avg(l_extendedprice/l_quantity) AS prc,
          avg(l_discount)-0.05 AS ret, sum(l_quantity) AS vol, count(*) AS shrout
        FROM lineitem GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE))""",
    "fx_port": """
        SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS rdate, avg(l_discount)-0.05 AS ret,
          100*(avg(l_tax)-0.04) AS port_ret
        FROM lineitem GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE))""",
    "fx_funda": """
        SELECT l_suppkey+1000 AS gvkey, year(l_shipdate) AS fyear, max(last_day(CAST(l_shipdate AS DATE))) AS datadate,
          sum(l_extendedprice)/1000 AS ceq, sum(l_tax) AS capx, sum(l_quantity) AS sale, sum(l_extendedprice) AS at,
          sum(l_extendedprice*l_discount) AS ni, sum(l_discount) AS che, sum(l_tax) AS rect, count(*) AS invt,
          sum(l_quantity) AS ppent, CASE WHEN count(*)%2=0 THEN sum(l_tax) END AS xad
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
    "fx_fundq": """
        SELECT l_suppkey+1000 AS gvkey, max(last_day(CAST(l_shipdate AS DATE))) AS datadate,
          sum(l_extendedprice)/1000 AS ceqq, sum(l_tax) AS capxy, sum(l_quantity) AS saleq, sum(l_extendedprice) AS atq,
          sum(l_extendedprice*l_discount) AS niq, sum(l_discount) AS cheq, sum(l_tax) AS rectq, count(*) AS invtq,
          sum(l_quantity) AS ppentq
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)""",
    "fx_ccm": """
        SELECT s_suppkey+1000 AS gvkey, s_suppkey AS lpermno, CASE WHEN s_suppkey%4=0 THEN 'NR' ELSE 'LU' END AS linktype,
          CASE WHEN s_suppkey%5=0 THEN NULL ELSE DATE '1996-01-01' END AS linkdt,
          CASE WHEN s_suppkey%3=0 THEN NULL ELSE DATE '2000-06-30' END AS linkenddt FROM supplier""",
    "fx_names": """
        SELECT p_partkey AS id, concat(p_name,' ',p_type,' Corp.') AS name_a, concat(p_name,' ',p_type,' ',p_brand) AS name_b
        FROM part""",
    "fx_transcripts": """
        SELECT conv_id AS transcriptid, turn AS ord, text AS componenttext FROM conversations""",
}

class Inputs:
    """Tables of one data directory; stand-ins are built on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        statement = STANDINS[name]
        for table in BASE_TABLES:
            if table in statement:
                self.base(table).createOrReplaceTempView(table)
        return self.spark.sql(statement)

    # -- derived inputs ------------------------------------------------------

    def panel(self) -> DataFrame:
        return panel_expand(self["fx_relation"], FIRST_YEAR, LAST_YEAR, OPEN_END)

    def identified(self) -> DataFrame:
        return identified_panel(self["fx_relation"], FIRST_YEAR, LAST_YEAR, OPEN_END)

    def lexicon(self) -> DataFrame:
        """Sentiment, risk and virus terms of the folder's own texts."""
        return (
            sentiment_lexicon(self.dictionary())
            .unionByName(risk_lexicon(self.synonym_lines()))
            .unionByName(covid_lexicon(self.spark))
        )

    def bigrams(self) -> DataFrame:
        return bigram_lexicon(self.bigram_table())

    def texts(self) -> DataFrame:
        """Texts of the documents, dealt by doc_id: a scan has no more tasks than row groups."""
        return self["documents"].select("doc_id", "text").repartition("doc_id").select("text")

    def dictionary(self) -> DataFrame:
        """A master dictionary: every document word with marks by its length."""
        word = F.explode(words_of("text"))
        words = self.texts().select(word.alias("w")).distinct()
        mark = lambda k: F.when(F.length("w") % k == 0, 2009).otherwise(0)
        return words.select(
            F.upper("w").alias("Word"), mark(5).alias("Positive"), mark(7).alias("Negative")
        )

    def synonym_lines(self) -> DataFrame:
        return self.texts().select(F.explode(F.split("text", "\n")).alias("value"))

    def bigram_table(self) -> DataFrame:
        """Word pairs of the transcripts with a weight from their count."""
        pair = F.explode(bigrams_of(words_of("text")))
        counted = self["conversations"].select(pair.alias("b")).groupBy("b").agg(
            F.count(F.lit(1)).alias("n")
        )
        return counted.select(
            F.translate("b", " ", "_").alias("bigram"), (F.col("n") * 0.125).alias("politicaltbb")
        )
