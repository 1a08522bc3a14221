"""Quality rules with verdicts per host, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainrisk.sources.staging import stage

WHITE = " \t\n\x0b\f\r"
_WHITE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the list."""
    digest = lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW))
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), digest)

    def covered(digests: Column) -> Column:
        pairs = F.sort_array(F.transform(digests, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(sorted_pairs: Column) -> Column:
            same = lambda p, k: F.coalesce(F.get(sorted_pairs, k)["h"] == p["h"], F.lit(False))
            marked = F.transform(sorted_pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        def width(found: Column) -> Column:
            own = F.transform(found, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(found, k + 1) - x), F.lit(WINDOW)))
            return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)

        bound = F.transform(F.array(pairs), starts)
        return F.transform(bound, width)[0]

    some = F.transform(
        F.array(windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("bigint"))
    )[0]
    return F.when(n >= WINDOW, some).otherwise(F.lit(0)).cast("bigint")


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base figures of each whole text; a null text has none of anything.

    Words are runs of characters other than ASCII white space.  Windows are compared by
    64-bit digests within their text.
    """
    blanks = F.lit(WHITE)
    stripped = lambda c: F.translate(c, WHITE, "")
    body = docs.select("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    words = F.filter(F.split("body", _WHITE_PATTERN), lambda w: w != "")
    lines = F.filter(F.split("body", "\n"), lambda x: F.length(F.btrim(x, blanks)) > 0)
    lists = body.select(
        "doc_id",
        "source",
        F.length(stripped(F.col("body"))).cast("bigint").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("bigint").alias("n_dup_lines"),
        words.alias("words"),
    )
    sized = lists.withColumn("n", F.size("words"))
    return sized.select(
        "doc_id",
        "source",
        F.col("n").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeat_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
    )


def host_verdicts(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """The figures of ``rule_counts`` with base_failed, host_rate, host_failed and kept.

    ``source`` is the host.  Failure rates of hosts are drawn towards a beta prior whose
    mean and spread are those of the rates of all hosts (method of moments), so that a
    host with few documents is judged by the others.  A host fails when its rate is above
    ``limit``; a document is kept if neither it nor its host fails.  With one host, or rates
    without spread, the prior counts as one document, or decides alone.  Null is a host.
    """
    counted = rule_counts(docs)
    few = F.col("n_words") < 20
    repeats = 100 * F.col("n_repeat_words") > 30 * F.col("n_words")
    figures = stage(counted.withColumn("base_failed", few | repeats), "rules")
    hosts = figures.groupBy(F.col("source").alias("host")).agg(
        F.sum(F.col("base_failed").cast("bigint")).alias("fails"), F.count(F.lit(1)).alias("n")
    )
    hosts = stage(hosts, "hosts")
    rates = hosts.agg(F.avg(F.col("fails") / F.col("n")).alias("mean"), F.var_samp(F.col("fails") / F.col("n")).alias("spread")).first()
    mean = rates["mean"] or 0.0
    if rates["spread"] is None:
        strength = 1.0
    elif rates["spread"] <= 0:
        strength = 1e9
    else:
        strength = max(mean * (1 - mean) / rates["spread"] - 1, 0.0)
    rate = (F.col("fails") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    judged = hosts.select("host", F.round(rate, 9).alias("host_rate"))
    return figures.join(judged, F.col("source").eqNullSafe(F.col("host"))).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "host_rate",
        (F.col("host_rate") > limit).alias("host_failed"),
        (~F.col("base_failed") & (F.col("host_rate") <= limit)).alias("kept"),
    )


def verdict_sql(relation: str = "documents", limit: float = 0.5) -> str:
    """DuckDB counterpart of ``host_verdicts``."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body FROM {relation}),
    w AS (SELECT *, list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(body, chr(10)), lambda x: trim(x, {blanks}) <> '') AS lines FROM t),
    g AS (SELECT r, unnest(range(0, greatest(len(words) - 7, 0))) AS i, words FROM w),
    h AS (SELECT r, i, array_to_string(words[i + 1 : i + 8], ' ') AS gram FROM g),
    d AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM h) WHERE c > 1),
    n AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM d GROUP BY r),
    f AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (r)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
    s AS (SELECT source AS host, count(*) FILTER (base_failed) AS fails, count(*) AS n FROM b GROUP BY source),
    m AS (SELECT avg(fails / n) AS mean, var_samp(fails / n) AS spread FROM s),
    p AS (SELECT mean, CASE WHEN spread IS NULL THEN 1.0 WHEN spread <= 0 THEN 1e9
                            ELSE greatest(mean * (1 - mean) / spread - 1, 0) END AS strength FROM m),
    v AS (SELECT host, round((fails + mean * strength) / (n + strength), 9) AS host_rate FROM s, p)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
           host_rate > {limit} AS host_failed, NOT base_failed AND host_rate <= {limit} AS kept
    FROM b JOIN v ON source IS NOT DISTINCT FROM host"""
