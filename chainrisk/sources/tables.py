"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainrisk.functions.values import nan_to_null

# The link types admitted between a firm and its security.
LINK_TYPES = ["LU", "LC", "LD", "LF", "LN", "LO", "LS", "LX"]


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """CSV files with a header, a declared schema and NaN read as NULL.

    ``path`` may be a list: shards with the same schema are one source.
    """
    df = spark.read.schema(schema).option("header", True).csv(path)
    return nan_to_null(df.select(*columns) if columns else df)


def read_parquet(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return nan_to_null(df.select(*columns) if columns else df)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str],
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Remote SQL table; filters and column lists are pushed to the server.

    With ``partition_column`` and ``bounds`` the read is split over executors.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return nan_to_null(reader.options(**options).load().select(*columns))


def between_dates(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Closed date range on the raw column, so that the scan can prune on it."""
    kind = df.schema[date].dataType.simpleString()
    return df.filter(F.col(date).between(F.lit(first).cast(kind), F.lit(last).cast(kind)))


def admitted_links(links: DataFrame, types: Sequence[str] = LINK_TYPES) -> DataFrame:
    return links.filter(F.col("linktype").isin(*types))


def first_rows(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows under a total order (a distributed top-n)."""
    return df.orderBy(*order).limit(n)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
