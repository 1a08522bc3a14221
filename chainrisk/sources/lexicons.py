"""Lexicons as DataFrames ``(term, tag, weight)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of the pandemic virus before normalisation.
COVID_TERMS = [
    "Coronavirus", "Corona virus", "coronavirus", "Covid-19", "COVID-19", "Covid19", "COVID19",
    "SARS-CoV-2", "2019-nCoV",
]


def sentiment_lexicon(dictionary: DataFrame) -> DataFrame:
    """Words of a master dictionary whose Positive / Negative mark is above zero."""
    marks = F.array(
        F.when(F.col("Positive") > 0, F.lit("positive")),
        F.when(F.col("Negative") > 0, F.lit("negative")),
    )
    return (
        dictionary.select(F.lower("Word").alias("term"), F.explode(marks).alias("tag"))
        .filter(F.col("tag").isNotNull() & F.col("term").isNotNull())
        .distinct()
    )


def risk_lexicon(lines: DataFrame, column: str = "value") -> DataFrame:
    """Blank-separated words of text lines, case kept."""
    token = F.explode(F.split(F.regexp_replace(F.col(column), "\n", ""), " "))
    return (
        lines.select(token.alias("term"))
        .filter(F.col("term") != "")
        .distinct()
        .withColumn("tag", F.lit("risk"))
    )


def read_risk_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return risk_lexicon(spark.read.text(path))


def bigram_lexicon(table: DataFrame) -> DataFrame:
    """``a_b`` keys to ``a b`` with their weight; a repeated key is an error."""
    term = F.replace(F.col("bigram"), F.lit("_"), F.lit(" "))
    repeated = F.raise_error(F.concat(F.lit("repeated bigram: "), F.col("term")))
    return (
        table.select(term.alias("term"), F.col("politicaltbb").alias("weight"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
        .select("term", F.when(F.col("n") > 1, repeated.cast("double")).otherwise(F.col("weight")).alias("weight"))
    )


def covid_lexicon(spark: SparkSession) -> DataFrame:
    """The normalised virus terms."""
    raw = spark.createDataFrame([(t,) for t in COVID_TERMS], "term string")
    plain = F.regexp_replace(F.lower("term"), "[^a-z ]", "")
    return raw.select(plain.alias("term")).distinct().withColumn("tag", F.lit("covid"))
