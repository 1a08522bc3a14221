"""Near copies by bottom-k sketches.

One hash function orders all word shingles; the sketch of a text is the k smallest
hashes of its set.  Two texts of similarity J share about J of the k smallest hashes
of their union, so a pair is worth checking only if it shares half of them:

1. equal sets are one class; each class is listed under its windows: RUN of its smallest
   values that follow each other in the order of the hashes.  A value alone is in as many
   sketches as there are texts with a common shingle, so that its list would meet in the
   square of the corpus; a window is shared by texts that are alike, and few others.  Linked
   texts share many windows, so each leaves out all but one of that number, the most frequent:
   those of a passage that very many texts share.  The number grows faster than the values
   that are taken, so windows take more of them (LISTED) than the estimate (RETAINED);
2. the lists generate pairs and their overlaps, families by pivots (``linking``);
3. the k smallest of both sketches together estimate the similarity of a pair, and
   components of pairs with an estimate of at least one half are families;
4. whole sets are built for members of families only.  A family may hold very many
   texts that are alike but not linked, so the pairs that go to verification are those
   that meet under the rarest shingles of both whole sets, early enough to link.

Sketches of sets of up to k shingles are the whole sets, and nothing is left to chance:
the shingles that two linked sets do not share cut the shared ones into so few pieces that
a known number of windows stays whole (``least_windows``), of two values where the sets are
very small (``window_sizes``).
Above, a link at the least similarity of 0.8 fails the estimate with a probability below
1e-9 (binomial tail: 96 draws at 0.8 giving less than 48), and one above it more seldom; it
shares fewer windows than are asked for with one below LOSS (``likely_windows``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.arrays import longs, mix, text_chunks
from chainrisk.llm.components import spread_join
from chainrisk.llm.jaccard_join import in_reach, set_digest, shingle_sets, verified
from chainrisk.llm.levels import corpus_levels, level_of
from chainrisk.llm.linking import linked_parts, of_pairs, with_components
from chainrisk.sources.staging import release, stage

#: Retained values of a sketch.
RETAINED = 96
#: Smallest values of a set that windows are made of.
LISTED = 192
#: Values of a window.
RUN = 3
#: Probability below which a link at the least similarity shares fewer windows than are asked for.
LOSS = 1e-10
#: Least counts of a "repeated", a "frequent" and a "very frequent" window or shingle.
STEPS = (2, 16, 256)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def sketch_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of sorted 64-bit hashes, as numbers of 63 bits."""
    return hashes[:k] >> np.uint64(1)


def least_overlap(n: int, k: int, percent: int) -> int:
    """Values that the sketch of a set of ``n`` shares with every sketch it may link to.

    If no partner can have more than k shingles, all sketches are whole sets and the
    similarity itself tells; otherwise half of the sketch.
    """
    if n * 100 // percent <= k:
        return -(-percent * n // 100)
    return -(-min(n, k) // 2)


def _unions(n: int, percent: int) -> list[tuple[int, int]]:
    """Size of the union, and how many of it are not shared at most, where a set of ``n`` links to a different one."""
    sizes = [(u, u * (100 - percent) // 100) for u in range(n, n * 100 // percent + 1)]
    return [(u, missing) for u, missing in sizes if missing]


@lru_cache(maxsize=None)
def window_sizes(n: int, percent: int) -> tuple[int, ...]:
    """Lengths of the windows of a set of ``n``: RUN, and less where linked sets may share no run of RUN.

    Both sets of a link take the length that the size of their union asks for.
    """
    if n > RETAINED:
        return (RUN,)
    # What is not shared cuts the shared ones of a union into pieces, one more at most.
    return tuple(sorted({min(RUN, -(-(u - missing) // (missing + 1))) for u, missing in _unions(n, percent)}))


@lru_cache(maxsize=None)
def likely_windows(k: int, percent: int) -> int:
    """Windows of RUN shared values among ``k`` draws that are shared with ``percent``, but for a chance of LOSS."""
    share = percent / 100
    # Chances by the shared values since the last other one (row) and the windows so far (column).
    chance = np.zeros((RUN + 1, k))
    chance[0, 0] = 1
    for _ in range(k):
        drawn = np.zeros_like(chance)
        drawn[0] = chance.sum(axis=0) * (1 - share)
        drawn[1:RUN] = chance[: RUN - 1] * share
        drawn[RUN, 1:] = (chance[RUN - 1] + chance[RUN])[:-1] * share
        chance = drawn
    return max(1, int(np.searchsorted(np.cumsum(chance.sum(axis=0)), LOSS)))


@lru_cache(maxsize=None)
def least_windows(n: int, k: int, percent: int) -> int:
    """Windows among the ``k`` smallest values that a set of ``n`` shares with every other set it links to."""
    if n * 100 // percent > k:
        return likely_windows(k, percent)
    # Both sets are whole.  A piece of r shared values holds r - RUN + 1 windows.
    shared = [u - missing - (RUN - 1) * (missing + 1) for u, missing in _unions(n, percent)]
    return max(1, min(shared, default=1))


def windows(sketch: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Hashes of the windows of a sketch of a set of ``n``."""
    out = [sketch[:0]]
    for length in window_sizes(n, percent):
        many = max(0, len(sketch) - length + 1)
        key = np.full(many, np.uint64(length))
        for at in range(length):
            key = mix(key * _TURN + sketch[at : at + many])
        out.append(key)
    return np.concatenate(out)


def _windows(batches: Iterable[pa.RecordBatch], size: int, percent: int, k: int) -> Iterator[np.ndarray]:
    for _, data, offsets in text_chunks(batches):
        yield np.concatenate([windows(sketch_of(s, k), len(s), percent) for s in shingle_sets(data, offsets, size)])


def _sketched(
    batches: Iterable[pa.RecordBatch], table: object, size: int, percent: int, k: int, retained: int = RETAINED
) -> Iterator[pa.RecordBatch]:
    """Set size, class, listed windows of the ``k`` smallest values, and sketch of each text."""
    empty = np.zeros(0, np.uint64)
    for rows, data, offsets in text_chunks(batches):
        sizes, classes, listed, sketches = [], [], [], []
        for s in shingle_sets(data, offsets, size):
            n = len(s)
            need = least_windows(n, k, percent)
            found = windows(sketch_of(s, k), n, percent)
            level = level_of(table.value, found)
            some = np.count_nonzero(level) >= need
            order = np.argsort(level << np.uint64(62) | found >> np.uint64(2), kind="stable")[: len(found) - need + 1]
            sizes.append(n)
            # Equal sets share all windows; a set without enough of them equals others only.
            classes.append(set_digest(s) if n and (some or len(found) < need) else None)
            listed.append(found[order[level[order] > 0]] if some else empty)
            sketches.append(sketch_of(s, retained) if some else empty)
        yield pa.record_batch(
            [rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), longs(listed), longs(sketches)],
            ["doc_id", "n", "class", "listed", "sketch"],
        )


def _class_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.array([int.from_bytes(c[:8], "little") for c in batch.column("class").to_pylist()], np.uint64)


def _whole_sets(batches: Iterable[pa.RecordBatch], table: object, size: int) -> Iterator[pa.RecordBatch]:
    """digest and shingles of the texts whose digest may be in ``table``."""
    for _, data, offsets in text_chunks(batches):
        sets = [(set_digest(s), s) for s in shingle_sets(data, offsets, size)]
        keys = np.array([int.from_bytes(c[:8], "little") for c, _ in sets], np.uint64)
        found = [sets[i] for i in np.flatnonzero(level_of(table.value, keys)).tolist()]
        yield pa.record_batch([pa.array([c for c, _ in found], pa.binary()), longs([s for _, s in found])], ["digest", "shingles"])


def _set_prefixes(batches: Iterable[pa.RecordBatch], table: object, percent: int) -> Iterator[pa.RecordBatch]:
    """class, n and the listed shingles of whole sets, after how many that no other set has."""
    for rows in batches:
        flat = rows.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(rows.column("shingles").value_lengths().to_numpy(zero_copy_only=False))
        level = level_of(table.value, flat)
        sizes, before, listed = [], [], []
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
            s, at, n = flat[lo:hi], level[lo:hi], hi - lo
            order = np.argsort(at << np.uint64(62) | s >> np.uint64(2), kind="stable")[: n - (percent * n + 99) // 100 + 1]
            met = order[at[order] > 0]
            sizes.append(n)
            before.append(len(order) - len(met))
            listed.append(s[met])
        yield pa.record_batch(
            [rows.column("class"), pa.array(sizes, pa.int64()), pa.array(before, pa.int64()), longs(listed)],
            ["class", "n", "before", "listed"],
        )


def _set_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for rows in batches:
        yield rows.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def alike(a: str, b: str, k: int) -> Column:
    """Do two sketches share at least half of the k smallest values of both together?"""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return common * 2 >= F.size(union)


def sketch_copies(docs: DataFrame, size: int = 2, percent: int = 80, k: int = RETAINED, listed: int = LISTED) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept: components of texts linked by similarity.

    Two texts link when 100 |A and B| >= percent |A or B| for their sets of ``size``-word
    shingles (A-Z lower-cased; a text of fewer words is one shingle).  ``component_id`` is
    the smallest doc_id that links reach from the row, its own included, and ``kept`` tells
    whether the row bears it.  Texts that are null, empty or without words have no shingle
    and link with nothing; repeated rows stay repeated, and rows that share their doc_id
    are kept or not together.  A row without doc_id takes no part: component_id null, kept.
    Ties do not arise, an empty table gives an empty result, other columns are ignored.
    ``k`` values of a set estimate similarities, windows are made of ``listed``.
    Runs jobs and stages tables.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be at least 75, or the estimate loses links, and at most 100")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = texts.where("doc_id is not null")
    table = corpus_levels(named.select("text"), lambda it: _windows(it, size, percent, listed), STEPS)
    rows = stage(
        texts.mapInArrow(
            lambda it: _sketched(it, table, size, percent, listed, k),
            "doc_id bigint, n bigint, class binary, listed array<bigint>, sketch array<bigint>",
        ),
        "sketches",
    )
    table.unpersist()
    first = [F.first(c).alias(c) for c in ("n", "listed", "sketch")]
    met = rows.withColumnRenamed("class", "digest").where("digest is not null and doc_id is not null")
    found = met.groupBy("digest").agg(F.min("doc_id").alias("low"), *first)
    # Digests do not compress: from here on a class is a number.
    classes = stage(found.withColumn("class", F.monotonically_increasing_id()), "classes")

    entries = classes.select(F.explode("listed").alias("token"), F.col("class").alias("group"), F.col("class").alias("head"), "n")

    def estimated(pairs: DataFrame) -> DataFrame:
        tried = of_pairs(classes.select("class", "sketch"), pairs)
        side = lambda c: tried.select(F.col("class").alias(c), F.col("sketch").alias(f"s{c}"))
        found = pairs.join(side("a"), "a").join(side("b"), "b").where(alike("sa", "sb", k)).select("a", "b")
        likely = stage(found, "estimated")
        release(tried)
        return likely

    member = classes.select(F.col("class").alias("group"), "class")
    likely = linked_parts(entries, member, estimated, percent, F.lit(True))
    several = likely.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    family = stage(spread_join(likely, several, "part", "class").where("k is not null").select("class", "part"), "families")

    digests = stage(family.select("class").join(classes.select("class", "digest"), "class"), "digests")
    table = corpus_levels(digests.select(F.col("digest").alias("class")), _class_keys, (1, 2, 3))
    built = texts.select("text").mapInArrow(lambda it: _whole_sets(it, table, size), "digest binary, shingles array<bigint>")
    built = built.join(digests, "digest").groupBy("digest", "class").agg(F.first("shingles").alias("shingles"))
    sets = stage(built.select("class", "shingles"), "sets")
    table.unpersist()

    table = corpus_levels(sets.select("shingles"), _set_hashes, STEPS)
    prefixes = sets.mapInArrow(
        lambda it: _set_prefixes(it, table, percent), "class bigint, n bigint, before bigint, listed array<bigint>"
    )
    spread = prefixes.select("class", "n", "before", F.posexplode("listed").alias("at", "shingle")).join(family, "class")
    entries = spread.select(
        F.xxhash64("part", "shingle").alias("token"), F.col("class").alias("group"), F.col("class").alias("head"), "n",
        (F.col("before") + F.col("at")).alias("rank"),
    )
    member = family.select(F.col("class").alias("group"), "class")
    links = lambda pairs: verified(estimated(pairs), sets, percent)
    parts = linked_parts(stage(entries, "prefixes"), member, links, percent, in_reach(percent))
    table.unpersist()
    ids = with_components(classes, parts)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        rows.select("doc_id", "n", F.col("class").alias("digest"))
        .join(ids, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
