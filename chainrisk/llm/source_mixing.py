"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainrisk.llm.hashing import draw, draw_sql, text_key
from chainrisk.sources.staging import stage


def tempered_weights(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """Columns source, weight: the number of documents of each source to a power."""
    return docs.groupBy("source").agg(F.pow(F.count(F.lit(1)), F.lit(power)).alias("weight"))


def poisson_mix(docs: DataFrame, weights: DataFrame, total: int | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` with each source repeated to its share of the weights, in a global random order.

    ``weights`` has one row per source (source, weight).  A source with weight w and n
    documents is repeated w / sum(w) * total / n times on average; ``total`` is the number
    of documents by default.  The number of copies of a document is a Poisson variable by
    inversion at a uniform hash of ``seed`` and doc_id, so it depends on no other document.
    Null is a source of its own; a source without a weight, or with a weight that is null
    or not above 0, gets no copies.  Equal rows, and rows with the same doc_id, draw alike.

    Returns all columns, ``mix_copy`` (from 1) and ``mix_key``; rows are dealt to
    partitions by a hash of the copy and sorted by mix_key.  Columns of docs with
    these two names are replaced.  The table of sources is staged, so that its size
    decides how it is joined; texts are shuffled once.
    """
    sizes = docs.groupBy(F.col("source").alias("m_source")).agg(F.count(F.lit(1)).alias("n"))
    target = weights.groupBy(F.col("source").alias("w_source")).agg(F.max("weight").alias("weight"))
    shares = sizes.join(target, F.col("m_source").eqNullSafe(F.col("w_source"))).where("weight > 0")
    shares = stage(shares.select("m_source", "n", "weight"), "shares")
    sums = shares.agg(F.sum("weight").alias("w")).first()
    count = total if total is not None else docs.count()
    rate = F.col("weight") / F.lit(float(sums.w or 1.0)) * F.lit(float(count)) / F.col("n")
    by_k = Window.partitionBy("m_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = shares.select("m_source", rate.alias("rate")).select(
        "m_source",
        "rate",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int"))).alias("k"),
    )
    # ln P(k) = -rate + sum over i <= k of ln(rate / i)
    logs = steps.withColumn(
        "log_p", F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log("k"))).over(by_k)
    )
    steps = logs.withColumn("below", F.sum(F.exp("log_p")).over(by_k))
    tables = steps.groupBy("m_source").agg(F.sort_array(F.collect_list("below")).alias("m_below"))
    tables = stage(tables, "rates")
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_key")]
    uniform = draw(seed, text_key("doc_id"))
    drawn = (
        docs.select(*kept)
        .join(tables, F.col("source").eqNullSafe(F.col("m_source")))
        .withColumn("m_u", uniform)
        .withColumn("m_copies", F.size(F.filter("m_below", lambda p: p < F.col("m_u"))))
        .where("m_copies > 0")
        .select(*kept, F.explode(F.sequence(F.lit(1), F.col("m_copies"))).alias("mix_copy"))
    )
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), text_key("doc_id"), F.col("mix_copy").cast("string")))
    return drawn.withColumn("mix_key", order).repartition("mix_key").sortWithinPartitions("mix_key")


def mix_sql(relation: str = "documents", power: float = 0.5, seed: str = "mix") -> str:
    """DuckDB counterpart of ``poisson_mix(docs, tempered_weights(docs, power))``."""
    u = draw_sql(f"'{seed}'", "coalesce(doc_id::VARCHAR, '')")
    return f"""
    WITH sized AS (SELECT source, count(*) AS n, pow(count(*), {power}) AS weight FROM {relation} GROUP BY source),
    rated AS (SELECT source, weight / (SELECT sum(weight) FROM sized) * (SELECT count(*) FROM {relation}) / n AS rate FROM sized),
    steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rated),
    logs AS (SELECT source, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k) END)
               OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS log_p FROM steps),
    sums AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS below FROM logs),
    lists AS (SELECT source AS s, list(below ORDER BY k) AS below FROM sums GROUP BY source),
    drawn AS (SELECT d.*, len(list_filter(below, lambda p: p < {u})) AS copies
              FROM {relation} d JOIN lists ON d.source IS NOT DISTINCT FROM s),
    repeated AS (SELECT *, unnest(range(1, copies + 1))::INTEGER AS mix_copy FROM drawn)
    SELECT doc_id, text, lang, source, n_chars, mix_copy,
           md5(concat_ws('|', '{seed}', 'order', coalesce(doc_id::VARCHAR, ''), mix_copy::VARCHAR)) AS mix_key
    FROM repeated"""
