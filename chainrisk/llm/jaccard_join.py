"""N-gram Jaccard join by grouped prefixes.

Texts become sets of word shingles.  One order of all shingles, rare before
frequent, comes from a count over the whole corpus.  Two sets with a Jaccard
similarity of at least t share a shingle among their first n - ceil(t n) + 1,
and shingles that occur once can be left out of that search.  So:

1. equal sets are one class, and classes with equal prefix and size one group;
2. groups meet through shared prefix shingles, families first by pivots and then
   under size and position filters (``linking``);
3. group pairs are expanded to member classes and verified on the whole sets.

Pairs inside a component are not enumerated: the result is the components, and
every link between two of them is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.arrays import SpanHash, distinct, lower, mix, text_chunks, word_spans
from chainrisk.llm.components import spread_join
from chainrisk.llm.levels import corpus_levels, level_of
from chainrisk.llm.linking import linked_parts, of_pairs, with_components
from chainrisk.sources.staging import release, stage

#: Least counts of a "repeated", a "frequent" and a "very frequent" shingle.
STEPS = (2, 32, 1024)
_SEED = np.uint64(0x51ED270B7F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased; a text of fewer than ``size`` words is one shingle, one
    without words has none.
    """
    data = lower(data)
    starts, ends, first = word_spans(data, offsets)
    words = SpanHash(data)(starts, ends)
    turn = [mix(np.array([k + 1], np.uint64) * _SEED)[0] | np.uint64(1) for k in range(size)]
    reach = max(0, len(words) - size + 1)
    whole = np.full(reach, np.uint64(size), np.uint64)
    for k in range(size):
        whole += words[k : k + reach] * turn[k]
    whole = mix(whole)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            yield distinct(whole[lo : hi - size + 1])
        elif hi > lo:
            few = np.array([hi - lo], np.uint64)
            for k in range(hi - lo):
                few += words[lo + k : lo + k + 1] * turn[k]
            yield mix(few)
        else:
            yield words[:0]


def _all_sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for _, data, offsets in text_chunks(batches):
        sets = list(shingle_sets(data, offsets, size))
        yield np.concatenate(sets)


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set of hashes and its size."""
    a = mix(hashes).sum(dtype=np.uint64)
    b = mix(hashes ^ _SEED).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return np.array([a, b], np.uint64).tobytes()


def _prefixes(
    batches: Iterable[pa.RecordBatch], table: object, size: int, percent: int
) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches):
        out: dict[str, list] = {k: [] for k in ("n", "class", "group", "tokens", "shingles")}
        for s in shingle_sets(data, offsets, size):
            n = len(s)
            out["n"].append(n)
            prefix = n - (percent * n + 99) // 100 + 1 if n else 0
            level = level_of(table.value, s)
            order = np.argsort(level << np.uint64(62) | s >> np.uint64(2), kind="stable")[:prefix]
            met = order[level[order] > 0]
            if not len(met):
                for k in ("class", "group", "tokens", "shingles"):
                    out[k].append(None)
                continue
            out["class"].append(set_digest(s))
            out["group"].append(set_digest(s[order]) + n.to_bytes(4, "big"))
            out["tokens"].append(s[met])
            out["shingles"].append(s)

        def lists(items: list) -> pa.Array:
            known = [x for x in items if x is not None]
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in items)])
            flat = np.concatenate(known).view(np.int64) if known else np.zeros(0, np.int64)
            mask = pa.array([x is None for x in items])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=mask)

        yield pa.record_batch(
            [
                rows.column("doc_id"),
                rows.column("text_hash"),
                pa.array(out["n"], pa.int64()),
                pa.array(out["class"], pa.binary()),
                pa.array(out["group"], pa.binary()),
                lists(out["tokens"]),
                lists(out["shingles"]),
            ],
            ["doc_id", "text_hash", "n", "class", "group", "tokens", "shingles"],
        )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The staged pairs (a, b) of classes whose whole sets reach the similarity, staged."""
    tried = of_pairs(sets, pairs)
    left = tried.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = tried.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    found = pairs.join(left, "a").join(right, "b").where(shared * 100 >= union * percent).select("a", "b")
    links = stage(found, "links")
    release(tried)
    return links


def in_reach(percent: int) -> Column:
    """Can two sets of n1 and n2 shingles link that first meet at rank1 and rank2 of one order?

    At the rarest shared token all other shared ones come later in both orders.
    """
    left = F.lit(1) + F.least(F.col("n1") - F.col("rank1") - 1, F.col("n2") - F.col("rank2") - 1)
    return left * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, text_hash, part: components of texts linked by similarity.

    Two texts link when 100 |A and B| >= percent |A or B| for their sets of
    ``size``-word shingles.  ``component_id`` is the smallest doc_id that links
    reach from the row, its own included.  Texts that are null, empty or without
    words have no shingle, link with nothing and are their own component; repeated
    rows stay repeated.  A row without doc_id takes no part: n_shingles of its text,
    component_id null.  ``part`` tells components apart even where texts that do not link
    bear the same doc_id; it is null for texts that no other row can link to.  Other
    columns are ignored.  Runs jobs and stages tables.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    named = texts.where("doc_id is not null")
    table = corpus_levels(named.select("text"), lambda it: _all_sets(it, size), STEPS)
    rows = stage(
        texts.mapInArrow(
            lambda it: _prefixes(it, table, size, percent),
            "doc_id bigint, text_hash bigint, n bigint, class binary, group binary, tokens array<bigint>, shingles array<bigint>",
        ),
        "prefixes",
    )
    table.unpersist()
    met = rows.withColumnRenamed("class", "digest").where("digest is not null and doc_id is not null")
    first = [F.first(c).alias(c) for c in ("n", "group", "tokens", "shingles")]
    found = met.groupBy("digest").agg(F.min("doc_id").alias("low"), *first)
    # Digests do not compress: from here on a class is a number, and a group its least class.
    classes = stage(found.withColumn("class", F.monotonically_increasing_id()), "classes")
    sets = classes.select("class", "shingles")
    groups = classes.groupBy("group").agg(
        F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min("class").alias("head")
    )
    groups = stage(groups, "groups")
    member = spread_join(classes.select("group", "class"), groups.select("group", "head"), "group", "class")
    member = stage(member.select(F.col("head").alias("group"), "class"), "members")
    # Tokens are the last part of the prefix, so a token's rank counts the unseen ones too.
    before = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.size("tokens")
    entries = groups.select("head", "n", before.alias("before"), F.posexplode("tokens").alias("at", "token"))
    entries = entries.select("token", F.col("head").alias("group"), "head", "n", (F.col("before") + F.col("at")).alias("rank"))
    parts = linked_parts(entries, member, lambda pairs: verified(pairs, sets, percent), percent, in_reach(percent))
    ids = with_components(classes, parts)
    return (
        rows.select("doc_id", "text_hash", "n", F.col("class").alias("digest"))
        .join(ids, "digest", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
            "text_hash",
            "part",
        )
    )


def components_sql(size: int = 5, percent: int = 75, kept: bool = False) -> str:
    """DuckDB counterpart over ``documents``: all pairs that share a shingle, and a closure of the links."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = f"list_transform(range(1, greatest(len(w) - {size - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {size - 1}], ' '))"
    extra = ", d.doc_id = c.component_id AS kept" if kept else ""
    return f"""
    WITH RECURSIVE t AS (SELECT doc_id, coalesce(regexp_extract_all({lowered}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({runs}) AS g FROM t WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY ALL
      HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))),
    r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
    c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id{extra}
    FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
