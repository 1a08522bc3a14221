"""Walks over numbered links, in tasks that hold the links of one side and period at a time.

Firms get dense numbers, the links of a side and period are packed into a few bytes each, and
every part of the starts gets its own copy of them.  A task then walks from its starts with
numpy: what the hops reach, and what is worked out per reached pair, is neither shuffled nor
staged.  Shuffled bytes grow with links times parts; the memory of a task with the links of a
side and period, the scores of all firms, and the firms times the starts at a time.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainrisk.sources.staging import stage

#: What tasks run of this module goes to them whole: they need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Firms of one packed piece.
PIECE_BITS = 16
#: Links that a task merges at a time, and starts that it walks from together.
LINKS_AT_ONCE = 4096
STARTS_AT_ONCE = 256
#: Links of a firm that are merged one by one with those of other firms, and bytes merged at a time.
ROUNDS = 256
ROUND_BYTES = 1 << 19
#: Words of 64 pairs, and rows of a result, that a task opens at a time.
WORDS_AT_ONCE = 1 << 15
ROWS_AT_ONCE = 1 << 19
#: Bytes of fills and of other tables over firms and starts that a task may hold.
STATE_BYTES = 64 << 20
FIRMS, SCORES, LINKS = 0, 1, 2
STREAM = "kind int, side string, year int, quarter int, piece bigint, keys binary, more binary"


class Numbered(NamedTuple):
    """``firms`` holds every ``firm`` with its ``id`` from 0 to ``count`` - 1."""

    firms: DataFrame
    count: int


def numbered(ends: DataFrame) -> Numbered:
    """Dense numbers, in order, for the values of the column ``firm``; nulls get none."""
    ranged = ends.select("firm").dropna().distinct().repartitionByRange("firm").sortWithinPartitions("firm")
    rows = stage(ranged.withColumn("at", F.monotonically_increasing_id()), "walk-firms")
    task = F.expr("shiftright(at, 33)")
    before, count = [], 0
    for number, found in sorted(tuple(r) for r in rows.groupBy(task).count().collect()):
        before += [F.lit(number), F.lit(count)]
        count += found
    offset = F.element_at(F.create_map(*before), task) if before else F.lit(0)
    return Numbered(rows.select("firm", (offset + F.expr("at & 8589934591")).cast("bigint").alias("id")), count)


# -- packed tables -------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = next(w for w in (1, 2, 4, 8) if not len(gaps) or int(gaps.max()) < 1 << 8 * w)
    planes = gaps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel(), dtype=np.int64)


def _row(table: pa.Table, kind: int, keys: bytes, more: bytes | None = None) -> pa.Table:
    first = table.slice(0, 1)
    column = lambda name, kind: first[name].cast(kind) if name in first.column_names else pa.nulls(1, kind)
    return pa.table(
        {
            "kind": pa.array([kind], pa.int32()),
            "side": column("side", pa.string()),
            "year": column("year", pa.int32()),
            "quarter": column("quarter", pa.int32()),
            "piece": column("piece", pa.int64()),
            "keys": pa.array([keys], pa.binary()),
            "more": pa.array([more], pa.binary()),
        }
    )


def _piece(column: str) -> Column:
    return F.expr(f"shiftright({column}, {PIECE_BITS})").alias("piece")


def packed_links(links: DataFrame, ends: Numbered, firm: str, partner: str, group: list[str]) -> DataFrame:
    """Distinct links by group and piece of the partners; links without one of both ends have no row."""
    number = lambda end, name: ends.firms.select(F.col("firm").alias(end), F.col("id").alias(name))
    rows = links.join(number(firm, "u"), firm).join(number(partner, "v"), partner).select(*group, "u", "v", _piece("v"))
    count = ends.count

    def pack(table: pa.Table) -> pa.Table:
        keys = table["v"].to_numpy() * count + table["u"].to_numpy()
        return _row(table, LINKS, packed(np.sort(keys)))

    return rows.groupBy(*group, "piece").applyInArrow(pack, STREAM)


def packed_firms(ends: Numbered) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy())
        column = pa.table({"firm": table["firm"].take(pa.array(order))}).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, column.schema) as writer:
            writer.write_table(column)
        return _row(table, FIRMS, zlib.compress(sink.getvalue().to_pybytes(), 1))

    return ends.firms.select("firm", "id", _piece("id")).groupBy("piece").applyInArrow(pack, STREAM)


def packed_scores(scores: DataFrame, ends: Numbered, period: list[str]) -> DataFrame:
    """Distinct scores (``firm``, ``score`` and the period) by period and piece of the firms, ascending."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scores.columns])
    rows = scores.filter(known).distinct().join(ends.firms, "firm").select(*period, "id", "score", _piece("id"))

    def pack(table: pa.Table) -> pa.Table:
        ids, values = table["id"].to_numpy(), table["score"].to_numpy()
        order = np.lexsort((values, ids))
        return _row(table, SCORES, packed(ids[order]), zlib.compress(values[order].astype("<f8").tobytes(), 1))

    return rows.groupBy(*period, "piece").applyInArrow(pack, STREAM)


def parts_of(df: DataFrame, count: int) -> int:
    """Parts of the starts: two for a core, and not less than 64 starts each."""
    return max(1, min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-count // 64)))


def dealt(tables: DataFrame, parts: int) -> DataFrame:
    """A copy of the packed tables for every part, in one task each, firms and scores first."""
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    return tables.select(part, "*").repartitionById(parts, F.col("part")).sortWithinPartitions(
        "part", "kind", "year", "quarter", "side", "piece"
    )


class Row(NamedTuple):
    part: int
    kind: int
    side: str
    year: int
    quarter: int
    piece: int
    keys: bytes
    more: bytes


def by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[Row]]]:
    """The rows of each part of :func:`dealt`."""
    part, rows = None, []
    for batch in batches:
        for values in zip(*(column.to_pylist() for column in batch.columns)):
            row = Row(*values)
            if row.part != part and rows:
                yield part, rows
                rows = []
            part = row.part
            rows.append(row)
    if rows:
        yield part, rows


# -- inside a task ---------------------------------------------------------------


def firm_keys(rows: Iterable[Row]) -> pa.Array:
    """The firms in order of their numbers."""
    read = [pa.ipc.open_stream(zlib.decompress(r.keys)).read_all()["firm"] for r in sorted(rows, key=lambda r: r.piece)]
    chunks = [c for column in read for c in column.chunks]
    return pa.concat_arrays(chunks)


class Steps:
    """Links of one group by their partner, over the numbers of the firms that it has."""

    def __init__(self, rows: Iterable[Row], count: int, at_once: int = LINKS_AT_ONCE, back: bool = False) -> None:
        keys = np.concatenate([unpacked(r.keys) for r in sorted(rows, key=lambda r: r.piece)])
        target, source = np.divmod(keys, count)
        if back:
            order = np.argsort(source, kind="stable")
            target, source = source[order], target[order]
        known = np.zeros(count, bool)
        known[source] = known[target] = True
        local = np.cumsum(known, dtype=np.int32) - np.int32(1)
        self.nodes = np.flatnonzero(known)
        self.source, self.target, self.at_once = local[source], local[target], at_once

    def places(self, firms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the firms are here, and where."""
        at = np.minimum(np.searchsorted(self.nodes, firms), len(self.nodes) - 1)
        here = np.flatnonzero(self.nodes[at] == firms)
        return here, at[here]

    def merged(self, rows: np.ndarray, how: np.ufunc) -> np.ndarray:
        """Every firm's merged rows of the firms that link to it."""
        out = np.zeros_like(rows)
        active = rows.any(axis=1)
        share = active.mean()
        if share >= 0.25:
            self._by_rounds(rows, how, out)
        elif share:
            chosen = np.flatnonzero(active[self.source])
            self._by_runs(self.source[chosen], self.target[chosen], rows, how, out)
        return out

    def _by_runs(self, source: np.ndarray, target: np.ndarray, rows: np.ndarray, how: np.ufunc, out: np.ndarray) -> None:
        """Merges links that are ordered by their target, about ``at_once`` at a time."""
        first = np.flatnonzero(np.diff(target, prepend=-1))
        heads, ends = target[first], np.append(first, len(source))
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(source), self.at_once)), len(first)))
        for low, high in zip(cuts, cuts[1:]):
            start, end = ends[low], ends[high]
            out[heads[low:high]] = how.reduceat(rows[source[start:end]], first[low:high] - start, axis=0)

    @cached_property
    def _rounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First links, numbers of links and targets, most links first, and the links beyond ``ROUNDS`` of a target."""
        first = np.flatnonzero(np.diff(self.target, prepend=-1))
        size = np.diff(np.append(first, len(self.target)))
        order = np.argsort(-size, kind="stable")
        place = np.arange(len(self.target)) - np.repeat(first, size)
        return first[order], size[order], self.target[first][order], np.flatnonzero(place >= ROUNDS)

    def _by_rounds(self, rows: np.ndarray, how: np.ufunc, out: np.ndarray) -> None:
        """Merges the first links of all targets, then the second ones and so on: whole rows at a time."""
        first, size, heads, beyond = self._rounds
        if len(beyond):
            self._by_runs(self.source[beyond], self.target[beyond], rows, how, out)
        block = max(1, ROUND_BYTES // rows[0].nbytes)
        room = np.empty((min(block, len(first)), rows.shape[1]), rows.dtype)
        for low in range(0, len(first), block):
            at, sizes, mine = first[low : low + block], size[low : low + block], heads[low : low + block]
            merged = out[mine]
            for k in range(min(int(sizes[0]), ROUNDS)):
                wide = np.searchsorted(-sizes, -k)
                np.take(rows, self.source[at[:wide] + k], axis=0, out=room[:wide], mode="clip")
                how(merged[:wide], room[:wide], out=merged[:wide])
            out[mine] = merged


def start_bits(step: Steps, starts: np.ndarray) -> np.ndarray:
    """One bit per start at its own firm."""
    rows = np.zeros((len(step.nodes), -(-len(starts) // 64)), "<u8")
    here, at = step.places(starts)
    rows[at, here >> 6] = np.uint64(1) << (here & 63).astype(np.uint64)
    return rows


def hops(step: Steps, starts: np.ndarray, degrees: int = 3) -> Iterator[tuple[int, np.ndarray]]:
    """Starts that reach each firm in one hop, two hops and so on, as bits."""
    rows = start_bits(step, starts)
    for degree in range(1, degrees + 1):
        rows = step.merged(rows, np.bitwise_or)
        yield degree, rows


def pairs(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the set bits as start and firm, a bounded number at a time and ordered by the start."""
    width = rows.shape[1]
    words = rows.ravel()
    places = np.flatnonzero(words)
    for low in range(0, len(places), WORDS_AT_ONCE):
        place = places[low : low + WORDS_AT_ONCE]
        hit = np.flatnonzero(np.unpackbits(words[place].view(np.uint8), bitorder="little"))
        at = place[hit >> 6]
        start = (at % width) * 64 + (hit & 63)
        order = np.argsort(start.astype(np.int16), kind="stable")
        yield start[order], at[order] // width


def lists(start: np.ndarray, rows: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows that are ordered by the start as one list a start."""
    first = np.flatnonzero(np.diff(start, prepend=-1))
    offsets = np.append(first, len(start)).astype(np.int32)
    return start[first], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def starts_at_once(bytes_a_start: int, most: int = STARTS_AT_ONCE) -> int:
    return int(max(8, min(most, STATE_BYTES // max(1, bytes_a_start))))


def groups_of(rows: Iterable[Row]) -> dict[tuple, list[Row]]:
    """Link rows by year, quarter and side, in order."""
    out: dict[tuple, list[Row]] = {}
    for r in rows:
        out.setdefault((r.year, r.quarter, r.side), []).append(r)
    return out


def dealt_by_period(tables: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """A copy of each period's packed tables for every part, in one task each, and the tasks.

    The part of a task is its number modulo ``parts``.
    """
    period = F.expr("year * 4 + quarter")
    order = [F.lit(x) for at, (p,) in enumerate(sorted(tables.select(period).distinct().collect())) for x in (p, at)]
    if not order:
        return dealt(tables, 1), 1
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    numbered_rows = tables.select((F.element_at(F.create_map(*order), period) * parts).alias("_at"), part.alias("_part"), "*")
    rows = numbered_rows.select((F.col("_at") + F.col("_part")).alias("part"), *tables.columns)
    tasks = len(order) // 2 * parts
    return rows.repartitionById(tasks, F.col("part")).sortWithinPartitions("part", "kind", "side", "piece"), tasks


def run_dealt(rows: DataFrame, task: Callable[[int, list[Row]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that ``task`` makes of each part."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in by_part(batches):
            yield from task(part, found)

    return rows.mapInArrow(walk, schema)


def run(tables: DataFrame, parts: int, task: Callable[[int, list[Row]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return run_dealt(dealt(tables, parts), task, schema)
