"""Connected components by contraction, with staged tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainrisk.sources.staging import stage


#: Parts that the rows of one key are spread over.
SPREAD = 16


def spread_join(rows: DataFrame, labels: DataFrame, key: str, by: str) -> DataFrame:
    """Left join on ``key`` for rows of which very many may share one key.

    The rows of a key are dealt by ``by`` over ``SPREAD`` tasks, and each row of
    ``labels`` (one per key) goes to all of them.
    """
    dealt = rows.withColumn("dealt_to", F.pmod(F.hash(by), F.lit(SPREAD)))
    copies = labels.withColumn("dealt_to", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(copies, [key, "dealt_to"], "left").drop("dealt_to")


def components(edges: DataFrame) -> DataFrame:
    """Columns ``v`` and ``label``: the smallest reachable vertex of each vertex of (a, b) edges.

    Each round hooks every vertex to its smallest neighbour, jumps one step further,
    and replaces the edges by those between different targets.  With hashed ids the
    number of vertices left falls by a constant factor per round.  Neighbours are only
    ever folded with ``min``, so no hub is gathered in one task.
    """
    left = stage(edges.where("a <> b").distinct(), "edges")
    done: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least("a", F.min("b")).alias("h")).select(F.col("a").alias("v"), "h")
        onward = hook.select(F.col("v").alias("h"), F.col("h").alias("h2"))
        jump = stage(spread_join(hook, onward, "h", "v").select("v", F.coalesce("h2", "h").alias("t")), "jump")
        if done is None:
            done = jump.select("v", F.col("t").alias("label"))
        else:
            step = jump.select(F.col("v").alias("label"), "t")
            done = spread_join(done, step, "label", "v").select("v", F.coalesce("t", "label").alias("label"))
            done = stage(done, "labels")
        ta, tb = jump.select(F.col("v").alias("a"), F.col("t").alias("ta")), jump.select(
            F.col("v").alias("b"), F.col("t").alias("tb")
        )
        moved = left.join(ta, "a").join(tb, "b").where("ta <> tb")
        left = stage(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if done is None:
        return left.select(F.col("a").alias("v"), F.col("b").alias("label"))
    low = done.groupBy("label").agg(F.min("v").alias("low"))
    return spread_join(done, low, "label", "v").select("v", F.col("low").alias("label"))
