"""Exact top-k inner products by MaxScore over shards.

A vector's components are the terms of a query and a shard's columns their postings.
Within a shard the score of a term lies between two bounds, so terms are ordered by
what they can still add.  Those that together cannot lift a vector over the k-th best
score so far are non-essential: postings of the essential terms are traversed, and the
others are probed only for vectors that stay competitive.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS = 4096, 512, 512


def whole_components(vector: str, scale: int) -> Column:
    """floor(scale * x) of all components as longs; null if the vector or a component is unusable."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _exact(*sides: np.ndarray) -> type:
    """float64 if all sums of products are exact in it, else int64."""
    most = [float(np.abs(s).max(initial=0)) for s in sides]
    return np.float64 if most[0] * most[1] * max(1, sides[0].shape[1]) < 2**52 else np.int64


def top_of_shard(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query row, id, score): the k best of the shard for each query, ties to smaller ids."""
    kind = _exact(queries, vectors)
    order = np.argsort(ids, kind="stable")
    ids, postings = ids[order], np.ascontiguousarray(vectors[order].T.astype(kind))
    high, low = postings.max(axis=1), postings.min(axis=1)
    found = []
    for row in range(len(queries)):
        q = queries[row].astype(kind)
        most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        terms = np.argsort(most - least, kind="stable")[::-1]  # those that can add most first
        rest = np.append(np.cumsum(most[terms][::-1])[::-1], 0)  # bound of the terms from a place on
        best_score, best_id = np.zeros(0, kind), np.zeros(0, np.int64)
        for at in range(0, len(ids), BLOCK_ROWS):
            block = slice(at, at + BLOCK_ROWS)
            live = np.flatnonzero(ids[block] != query_ids[row]) + at
            if len(best_score) < k:
                score = q @ postings[:, live]
            else:
                bar = best_score[-1]
                # Essential: the shortest head of terms whose absence leaves no vector competitive.
                total = np.cumsum(np.append(0, least[terms]))
                head = int(np.searchsorted(-(total + rest), -bar, side="left")) if len(terms) else 0
                head = min(max(head, len(terms) // 4, 1), len(terms))
                part = q[terms[:head]] @ postings[terms[:head]][:, live]
                fit = part + rest[head] > bar
                live, part = live[fit], part[fit]
                for lo in range(head, len(terms), 16):  # probe the others while competitive
                    if not len(live):
                        break
                    more = terms[lo : lo + 16]
                    part = part + q[more] @ postings[np.ix_(more, live)]
                    fit = part + rest[min(lo + 16, len(terms))] > bar
                    live, part = live[fit], part[fit]
                score = part
            if len(live):
                both, names = np.append(best_score, score), np.append(best_id, ids[live])
                keep = np.lexsort((names, -both))[:k]
                best_score, best_id = both[keep], names[keep]
        found.extend((row, int(i), int(s)) for i, s in zip(best_id, best_score))
    return found


def _cell(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple[int, int, int]] = []
    if len(queries) and len(vectors):
        width = max(max(map(len, queries["v"])), max(map(len, vectors["v"])), 1)
        ids = queries["vec_id"].to_numpy()
        found = top_of_shard(_matrix(queries["v"], width), ids, _matrix(vectors["v"], width), vectors["vec_id"].to_numpy(), k)
        rows = queries["row"].to_numpy()
        out = [(int(rows[r]), int(ids[r]), i, s) for r, i, s in found]
    return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]).astype("int64")


def maxscore_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query.

    Both sides have vec_id and ``v`` (array of longs); a shorter vector counts as padded
    with zeros.  Vectors with the query's own vec_id are left out, ties go to the smaller
    vec_id, and a repeated query is answered once per row.  Rows with a null id or vector
    take no part.  Queries in blocks meet vectors in shards, one task per pair of a block
    and a shard; sizes of both are fixed, their numbers follow the input.
    """
    queries = queries.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("bigint"), "v")
    vectors = vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("bigint"), "v")
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    row = F.monotonically_increasing_id()
    ask = queries.withColumn("row", row).select(
        "row", "vec_id", "v", F.pmod("row", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    hold = vectors.withColumn("row", row).select(
        "vec_id", "v", F.pmod("row", F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
    )
    cells = ask.groupBy("block", "shard").cogroup(hold.groupBy("block", "shard"))
    near = cells.applyInPandas(lambda q, v: _cell(q, v, k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
