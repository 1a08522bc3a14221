"""Company-name matching by token-set similarity inside first-letter blocks.

The score of two names is the best of three comparisons between their shared
tokens ``I`` and the full token strings ``A`` and ``B`` (shared tokens first):
I-A, I-B and A-B, each ``2 * LCS / (total length)`` in percent.  Only pairs at
or above the cutoff are wanted, and no block is compared pair by pair.  A pair
can reach the cutoff ``c`` in two ways, and each has an exact filter:

* *covered*: the shared tokens make up most of one name.  Then the rarest
  tokens of that name, up to the weight that may be missing, contain a shared
  token.
* *near spelling*: the full strings differ by at most ``D`` inserted or deleted
  characters, and ``D`` is bounded by the name's own length.  One edit breaks
  at most ``q`` of its q-grams, so among its ``q * D + 1`` rarest q-grams one
  survives in the other name, whose length is close.  Counting all surviving
  q-grams then removes most pairs before they are scored.

Both become equi-joins on a rare key.  Keys that are frequent all the same are
salted by their counted frequency.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainrisk.functions.text import base_name, name_tokens
from chainrisk.sources.staging import stage

CUTOFF = 90
TOP = 5
GRAM_SIZES = (1, 2, 3)  # lengths offered for the joins
COUNTED_GRAMS = (1, 2)  # lengths counted before a pair is scored
SALT_ROWS = 20_000


def least(cutoff: int) -> float:
    """Smallest unrounded similarity that rounds to the cutoff."""
    return (cutoff - 0.5) / 100


def common_subsequence(left: Column | str, right: Column | str) -> Column:
    """Length of the longest common subsequence, one bit per character."""

    def length(a: str, b: str) -> int:
        if len(a) < len(b):
            a, b = b, a
        masks: dict[str, int] = {}
        for i, ch in enumerate(b):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        full = (1 << len(b)) - 1
        row = full
        for ch in a:
            hit = row & masks.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(b) - row.bit_count()

    # Defined here, not at module level, so that tasks need no copy of the package.
    @F.pandas_udf(T.IntegerType())
    def lengths(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a_batch, b_batch in pairs:
            yield pd.Series([length(a, b) for a, b in zip(a_batch, b_batch)], dtype="int32")

    return lengths(left, right)


def normalised_names(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, base_name(column))


def _profile(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with first letter, tokens and length of the token string."""
    return (
        names.select(F.col(column).cast("string").alias("name"))
        .filter(F.col("name").isNotNull())
        .distinct()
        .select(
            "name",
            F.substring("name", 1, 1).alias("letter"),
            name_tokens("name").alias("tokens"),
        )
        .filter(F.size("tokens") > 0)
        .withColumn("len", F.length(F.array_join("tokens", " ")))
    )


def _grams(q: int) -> Column:
    """All q-grams inside the tokens, repeats kept."""
    per_token = F.transform(
        "tokens",
        lambda t: F.when(
            F.length(t) >= q,
            F.transform(
                F.sequence(F.lit(1), F.length(t) - (q - 1)),
                lambda i: F.concat(F.lit(f"{q}:"), F.substring(t, i, F.lit(q))),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.flatten(per_token)


def _frequency(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("letter", "key").agg(F.count(F.lit(1)).alias("df"))


def _salted_join(few: DataFrame, many: DataFrame, frequency: DataFrame, close: float | None = None) -> DataFrame:
    """Join names on (letter, key); ``few`` is repeated per salt of a hot key.

    ``close`` also asks for lengths that reach this similarity, through a logarithmic bucket.
    """
    salts = F.ceil(F.greatest("df", F.lit(1)) / SALT_ROWS).cast("int")
    if close is None:
        bucket = F.lit(0)
        spread = F.array(bucket)
    else:
        step = math.log((2 - close) / close) + 1e-6  # two lengths that still reach the cutoff
        bucket = F.floor(F.log("len") / step)
        spread = F.array(bucket - 1, bucket, bucket + 1)
    left = (
        few.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .withColumn("bucket", F.explode(spread))
        .withColumnRenamed("name", "few_name")
        .drop("len", "df")
    )
    right = (
        many.select("letter", "key", "name", "len")
        .distinct()
        .join(frequency, ["letter", "key"])
        .select(
            "letter",
            "key",
            F.pmod(F.xxhash64("name"), salts).cast("int").alias("salt"),
            bucket.alias("bucket"),
            F.col("name").alias("many_name"),
        )
    )
    return left.join(right, ["letter", "key", "salt", "bucket"])


def _covered_pairs(covered: DataFrame, other: DataFrame, frequency: DataFrame, low: float) -> DataFrame:
    """Pairs in which the shared tokens may make up enough of the ``covered`` name.

    Its tokens are taken in order of rarity until their weight exceeds what may
    be missing: one of them must be shared.
    """
    missing = 2 * (1 - low) / (2 - low)
    order = W.partitionBy("name").orderBy("df", "key").rowsBetween(W.unboundedPreceding, -1)
    rare = (
        covered.join(frequency, ["letter", "key"])
        .withColumn("before", F.coalesce(F.sum(F.length("key") + 1).over(order), F.lit(0)))
        .filter(F.col("before") <= F.col("len") * missing + 1e-6)
        .select("name", "letter", "key", "len", "df")
    )
    return _salted_join(rare, other, frequency).select("few_name", "many_name")


def _near_pairs(queries: DataFrame, candidates: DataFrame, low: float) -> DataFrame:
    """Pairs of similar length that share a rare q-gram.

    Of the ``q * D + 1`` rarest q-grams of a query one survives ``D`` edits.
    Every ``q`` for which the query has that many is exact, so each query takes
    the one whose grams occur least often among the candidates.  A query too short
    for any edit is near only to its own tokens, which cover it.
    """
    edits = F.floor(F.col("len") * ((1 - low) * (1 + (2 - low) / low)) + 1e-6)
    sized = [F.struct(F.lit(q).alias("q"), _grams(q).alias("grams")) for q in GRAM_SIZES]
    offers = (
        queries.select("name", "letter", "tokens", "len", edits.alias("edits"))
        .filter(F.col("edits") > 0)
        .select("name", "letter", "len", "edits", F.explode(F.array(*sized)).alias("g"))
        .select("name", "letter", "len", "g.q", "g.grams", (F.col("g.q") * F.col("edits")).alias("broken"))
        .filter(F.size("grams") > F.col("broken"))
        .select("name", "letter", "len", "q", "broken", F.explode("grams").alias("key"))
    )
    grams = candidates.select(
        "name", "letter", "len",
        F.explode(F.array_distinct(F.concat(*[_grams(q) for q in GRAM_SIZES]))).alias("key"),
    )
    frequency = _frequency(grams)
    order = W.partitionBy("name", "q").orderBy("df", "key")
    rare = (
        offers.join(frequency, ["letter", "key"], "left")
        .fillna(0, ["df"])  # a gram that no candidate has is the rarest
        .withColumn("nr", F.row_number().over(order))
        .filter(F.col("nr") <= F.col("broken") + 1)
        .groupBy("name", "letter", "len", "q", "key")
        .agg(F.max("df").alias("df"))
        .withColumn("cost", F.sum("df").over(W.partitionBy("name", "q")))
        .withColumn("best", F.min(F.struct("cost", "q")).over(W.partitionBy("name")))
        .filter((F.col("q") == F.col("best.q")) & (F.col("df") > 0))
        .select("name", "letter", "len", "key", "df")
    )
    return _salted_join(rare, grams, frequency, low).select("few_name", "many_name")


def candidate_pairs(queries: DataFrame, candidates: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """Every pair (name_a, name_b) that can reach the cutoff, and few others."""
    low = least(cutoff)

    def tokens(df: DataFrame) -> DataFrame:
        return df.select("name", "letter", "len", F.explode("tokens").alias("key"))

    a, b = tokens(queries), tokens(candidates)
    frequency = _frequency(a.unionAll(b))

    def named(df: DataFrame, first: str, second: str) -> DataFrame:
        return df.select(F.col(first).alias("name_a"), F.col(second).alias("name_b"))

    return (
        named(_covered_pairs(a, b, frequency, low), "few_name", "many_name")
        .unionAll(named(_covered_pairs(b, a, frequency, low), "many_name", "few_name"))
        .unionAll(named(_near_pairs(queries, candidates, low), "few_name", "many_name"))
        .distinct()
    )


def score_pairs(
    pairs: DataFrame, queries: DataFrame, candidates: DataFrame, cutoff: int = CUTOFF
) -> DataFrame:
    """Token-set similarity of candidate pairs; pairs below the cutoff are dropped."""

    def side(df: DataFrame, end: str) -> DataFrame:
        grams = [_grams(q).alias(f"g{q}{end}") for q in COUNTED_GRAMS]
        own = {"name": f"name_{end}", "tokens": f"t{end}", "len": f"l{end}"}
        return df.select("name", "tokens", "len", *grams).withColumnsRenamed(own)

    a, b = side(queries, "a"), side(candidates, "b")
    split = (
        pairs.join(a, "name_a")
        .join(b, "name_b")
        .withColumns(
            {
                "shared": F.length(F.array_join(F.array_intersect("ta", "tb"), " ")),
                "da": F.array_join(F.array_except("ta", "tb"), " "),
                "db": F.array_join(F.array_except("tb", "ta"), " "),
            }
        )
    )
    shared, total = F.col("shared"), F.col("la") + F.col("lb")
    both = (F.length("da") > 0) & (F.length("db") > 0)
    joint = shared + F.when((shared > 0) & both, 1).otherwise(0)

    def percent(common: Column, length: Column) -> Column:
        return F.rint(F.lit(100.0) * (common * 2 / length)).cast("int")

    def with_shared(length: str) -> Column:
        return F.when(shared > 0, percent(shared, shared + F.col(length))).otherwise(0)

    best_shared = F.greatest(with_shared("la"), with_shared("lb"))
    bound = percent(joint + F.least(F.length("da"), F.length("db")), total)
    edits = F.floor(total * (1 - least(cutoff)) + 1e-6)
    near = bound >= cutoff
    for q in COUNTED_GRAMS:
        kept = F.size(F.expr(f"filter(g{q}a, g -> array_contains(g{q}b, g))"))
        near = near & (kept >= F.size(f"g{q}a") - edits * q)
    feasible = split.filter((best_shared >= cutoff) | near).drop(
        *[f"g{q}{end}" for q in COUNTED_GRAMS for end in "ab"]
    )
    common = feasible.withColumn("lcs", common_subsequence("da", "db"))
    score = F.greatest(best_shared, percent(joint + F.col("lcs"), total))
    return common.withColumn("score", score).filter(F.col("score") >= cutoff).select(
        "name_a", "name_b", "score"
    )


def name_matches(
    queries: DataFrame, query_column: str, candidates: DataFrame, candidate_column: str
) -> DataFrame:
    """All pairs of distinct names with equal first letter at or above the cutoff."""
    a = stage(_profile(queries, query_column), "names-a")
    b = stage(_profile(candidates, candidate_column), "names-b")
    return score_pairs(candidate_pairs(a, b), a, b)


def best_matches(matches: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best candidates per name: score, then candidate order."""
    order = W.partitionBy("name_a").orderBy(F.col("score").desc(), "name_b")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_matches(
    queries: DataFrame, query_column: str, candidates: DataFrame, candidate_column: str
) -> DataFrame:
    """The best candidate of each name, as ``best_matches(name_matches(...), 1)`` gives it.

    A name with a full score needs no other: full scores are looked for first, which few
    candidates can reach, and only names without one are compared down to the cutoff.
    """
    a = stage(_profile(queries, query_column), "names-a")
    b = stage(_profile(candidates, candidate_column), "names-b")
    full = stage(best_matches(score_pairs(candidate_pairs(a, b, 100), a, b, 100), 1), "names-full")
    rest = stage(a.join(full.select(F.col("name_a").alias("name")), "name", "left_anti"), "names-rest")
    return full.unionByName(best_matches(score_pairs(candidate_pairs(rest, b), rest, b), 1))


def matched_link_table(link: DataFrame, names: DataFrame) -> DataFrame:
    """Link table keyed by the best matching panel name of each company."""
    based = normalised_names(link, "coname")
    best = top_matches(based, "coname", names, "name")
    return (
        based.join(best.select(F.col("name_a").alias("coname"), "name_b"), "coname")
        .select(F.col("name_b").alias("coname"), "gvkey", "FNDATE", "LNDATE")
        .distinct()
        .dropna("any")
    )
