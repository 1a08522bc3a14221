"""Partners over hops and declines of their scores, worked out per start in the tasks of ``walks``.

A task goes through the periods in order.  A pair's scores lie in one table of all scores, by
period and partner; what is carried forward along a link is the period it came from, kept
only for partners that have a period without a score behind one with a score.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainrisk.operators.walks import (
    FIRMS,
    LINKS,
    ROWS_AT_ONCE,
    SCORES,
    STARTS_AT_ONCE,
    Numbered,
    Row,
    Steps,
    firm_keys,
    groups_of,
    hops,
    lists,
    numbered,
    packed_firms,
    packed_links,
    packed_scores,
    pairs,
    parts_of,
    run,
    starts_at_once,
    unpacked,
)
from chainrisk.sources.staging import stage

#: What tasks run of this module goes to them whole, as what they run of ``walks``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Quarter of links whose quarter is not known: they have no further hop.
NO_QUARTER = -1
DEGREES = (1, 2, 3)
GROUP = ["side", "year", "quarter"]


class Walks(NamedTuple):
    """Distinct links (``base``), their firms by number, and both packed.

    ``loose`` holds the links without a side or firm, if there are any; they are not packed.
    """

    base: DataFrame
    ends: Numbered
    tables: DataFrame
    at_once: int
    loose: DataFrame | None

    @property
    def firm_type(self) -> str:
        return self.base.schema["firm_gvkey"].dataType.simpleString()


def walks(links: DataFrame, at_once: int) -> Walks:
    """Packed links of a long link table.  Runs jobs and stages tables."""
    base = stage(links.select("firm_gvkey", "partner_gvkey", *GROUP).distinct(), "degree-1")
    ends = numbered(base.select(F.explode(F.array("firm_gvkey", "partner_gvkey")).alias("firm")))
    known = base.filter(F.col("side").isNotNull() & F.col("year").isNotNull())
    grouped = known.withColumn("quarter", F.coalesce("quarter", F.lit(NO_QUARTER)))
    tables = packed_links(grouped, ends, "firm_gvkey", "partner_gvkey", GROUP).unionByName(packed_firms(ends))
    loose = base.filter(F.col("side").isNull() | F.col("firm_gvkey").isNull())
    return Walks(base, ends, stage(tables, "degree-packed"), at_once, None if loose.isEmpty() else loose)


# -- inside a task ---------------------------------------------------------------


class Part:
    """Links and firms of one part of the starts."""

    def __init__(self, part: int, parts: int, rows: list[Row], count: int, at_once: int) -> None:
        self.firms = firm_keys(r for r in rows if r.kind == FIRMS)
        self.groups = groups_of(r for r in rows if r.kind == LINKS)
        self.starts = np.arange(part, count, parts)
        self.count, self.at_once = count, at_once
        self._steps: dict[tuple, Steps] = {}

    def step(self, group: tuple) -> Steps:
        if group not in self._steps:
            self._steps[group] = Steps(self.groups[group], self.count, self.at_once)
            self.groups[group] = []
        return self._steps[group]

    def hops(self, group: tuple, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield from hops(self.step(group), starts, 1 if group[1] == NO_QUARTER else len(DEGREES))


class Series:
    """All scores by period and firm; the scores of a firm and period are distinct and ascend."""

    def __init__(self, rows: list[Row], count: int, period_of: Callable[[Row], int], periods: list[int]) -> None:
        found = [(period_of(r), r) for r in rows if r.kind == SCORES]
        self.first = min([t for t, _ in found] + periods, default=0)
        length = max([t for t, _ in found] + periods, default=0) - self.first + 1
        self.size = np.zeros((length, count), np.int32)
        self.at = np.zeros((length, count), np.int32)
        values, used = [np.zeros(0)], 0
        for t, r in found:
            ids = unpacked(r.keys)
            values.append(np.frombuffer(zlib.decompress(r.more), "<f8"))
            firms, start, size = np.unique(ids, return_index=True, return_counts=True)
            self.at[t - self.first, firms] = start + used
            self.size[t - self.first, firms] = size
            used += len(ids)
        self.values = np.concatenate(values)
        # Compared by rank: a value that is not a number is above all others.
        self.rank = np.unique(self.values, return_inverse=True)[1].astype(np.int32)

    def top(self, index: np.ndarray, firm: np.ndarray) -> np.ndarray:
        """Place of the largest score of each firm in the period of that index."""
        return self.at[index, firm] + self.size[index, firm] - 1

    def gaps(self) -> np.ndarray:
        """Number of each firm among those with an empty period behind a score; -1 for others."""
        seen = np.logical_or.accumulate(self.size > 0, axis=0)
        gap = (seen & (self.size == 0)).any(axis=0)
        return np.where(gap, np.cumsum(gap) - 1, -1)


class Rows(NamedTuple):
    """Rows of pairs: the pair's place, and the places of its score and of the one before."""

    pair: np.ndarray
    own: np.ndarray
    last: np.ndarray


class Found(NamedTuple):
    """Pairs with rows: start (its place among those walked from), partner, and rows and declines of each."""

    start: np.ndarray
    partner: np.ndarray
    rows: np.ndarray
    declines: np.ndarray
    of: Callable[[np.ndarray], Rows]


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair and place within the pair of every row."""
    pair = np.repeat(np.arange(len(sizes)), sizes)
    return pair, np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Quarterly:
    """Scores of a quarter against the same quarter of the year before, carried forward along the link."""

    BACK = 4

    def __init__(self, part: Part, rows: list[Row]) -> None:
        self.part = part
        self.periods = sorted(g for g in part.groups if g[1] != NO_QUARTER)
        here = [self.at(g) for g in self.periods]
        self.series = Series(rows, part.count, lambda r: r.year * 4 + r.quarter - 1, here + [t - self.BACK for t in here])
        self.gap = self.series.gaps()
        self.state_bytes = 2 * 2 * len(DEGREES) * 2 * int(self.gap.max(initial=-1) + 1)

    @staticmethod
    def at(group: tuple) -> int:
        return group[0] * 4 + group[1] - 1

    def begin(self, side: str, size: int) -> None:
        shape = (2, len(DEGREES) + 1, int(self.gap.max(initial=-1)) + 1, size)
        self.fills = np.zeros(shape, np.uint16)

    def steps(self, side: str, starts: np.ndarray) -> Iterator[tuple[int, int, int, Callable[[], Iterator[tuple]]]]:
        """Year, quarter and degree with the pairs of that time."""
        for group in self.periods:
            if group[2] == side:
                nodes = self.part.step(group).nodes
                for degree, bits in self.part.hops(group, starts):
                    yield group[0], group[1], degree, lambda bits=bits, nodes=nodes: ((s, nodes[p]) for s, p in pairs(bits))

    def found(self, year: int, quarter: int, degree: int, start: np.ndarray, partner: np.ndarray) -> Found:
        series, t = self.series, year * 4 + quarter - 1 - self.series.first
        at, size = [], []
        gap = self.gap[partner]
        for which, index in enumerate((t, t - self.BACK)):
            place, number = series.at[index, partner], series.size[index, partner]
            held = np.flatnonzero(gap >= 0)
            if len(held):
                fills = self.fills[which, degree]
                known = held[number[held] > 0]
                fills[gap[known], start[known]] = index + 1
                empty = held[number[held] == 0]
                source = fills[gap[empty], start[empty]].astype(np.int64)
                empty, source = empty[source > 0], source[source > 0] - 1
                place[empty] = series.top(source, partner[empty])
                number[empty] = 1
            at.append(place)
            size.append(number)
        kept = np.flatnonzero((size[0] > 0) & (size[1] > 0))
        (own, last), (owns, lasts) = ([x[kept] for x in y] for y in (at, size))
        rows = owns * lasts

        def of(chosen: np.ndarray) -> Rows:
            pair, place = _spread(rows[chosen])
            pair = chosen[pair]
            return Rows(pair, own[pair] + place // lasts[pair], last[pair] + place % lasts[pair])

        declines = np.zeros(len(kept), np.int64)
        most = int(owns.max(initial=0))
        for k in range(most):  # a pair has a few scores
            for j in range(int(lasts.max(initial=0))):
                some = np.flatnonzero((owns > k) & (lasts > j))
                declines[some] += series.rank[own[some] + k] < series.rank[last[some] + j]
        return Found(start[kept], partner[kept], rows, declines, of)

    def passed(self, year: int, degree: int, start: np.ndarray, partner: np.ndarray) -> None:
        """Fills of a quarter are its own scores, so looking at it again changes nothing."""


class Annual:
    """Scores of a year against the link's previous row, in order of year and score."""

    def __init__(self, part: Part, rows: list[Row]) -> None:
        self.part = part
        self.years = sorted({g[0] for g in part.groups})
        self.series = Series(rows, part.count, lambda r: r.year, self.years)
        some = (self.series.size > 0).any(axis=0)
        self.number = np.where(some, np.cumsum(some) - 1, -1)
        self.state_bytes = 2 * len(DEGREES) * int(some.sum()) + len(DEGREES) * part.count // 8

    def begin(self, side: str, size: int) -> None:
        self.fills = np.zeros((len(DEGREES) + 1, int(self.number.max(initial=-1)) + 1, size), np.uint16)

    def steps(self, side: str, starts: np.ndarray) -> Iterator[tuple[int, None, int, Callable[[], Iterator[tuple]]]]:
        for year in self.years:
            bits = np.zeros((len(DEGREES) + 1, self.part.count, -(-len(starts) // 64)), "<u8")
            for group in sorted(g for g in self.part.groups if g[0] == year and g[2] == side):
                nodes = self.part.step(group).nodes
                for degree, here in self.part.hops(group, starts):
                    bits[degree, nodes] |= here
            for degree in DEGREES:
                yield year, None, degree, lambda rows=bits[degree]: pairs(rows)

    def found(self, year: int, quarter: None, degree: int, start: np.ndarray, partner: np.ndarray) -> Found:
        series, t = self.series, year - self.series.first
        known = np.flatnonzero(self.number[partner] >= 0)
        start, partner = start[known], partner[known]
        number = self.number[partner]
        fills = self.fills[degree]
        source = fills[number, start].astype(np.int64)
        # Another look at the year's own pairs must not find their own fill.
        size, at = series.size[t, partner], series.at[t, partner]
        before = np.where(source > 0, series.top(source - 1, partner), -1)
        rows = (source > 0) + np.maximum(size - 1, 0)
        kept = np.flatnonzero(rows)
        own, fill, sizes, rows_kept = at[kept], before[kept], size[kept], rows[kept]

        def of(chosen: np.ndarray) -> Rows:
            pair, place = _spread(rows_kept[chosen])
            pair = chosen[pair]
            # The least score follows what the link had before, each other one the score below it.
            place = place + (fill[pair] < 0)
            mine = np.where(sizes[pair] > 0, own[pair] + place, fill[pair])
            return Rows(pair, mine, np.where(place == 0, fill[pair], own[pair] + place - 1))

        falls = (sizes > 0) & (fill >= 0)
        declines = (falls & (series.rank[np.where(falls, own, 0)] < series.rank[np.where(falls, fill, 0)])).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
        return Found(start[kept], partner[kept], rows_kept, declines, of)

    def passed(self, year: int, degree: int, start: np.ndarray, partner: np.ndarray) -> None:
        """Carry the year's scores forward, once its rows are made."""
        scored = np.flatnonzero((self.number[partner] >= 0) & (self.series.size[year - self.series.first, partner] > 0))
        self.fills[degree][self.number[partner[scored]], start[scored]] = year - self.series.first + 1


class Buffer:
    """Rows of a result by column, given out as batches."""

    def __init__(self, names: list[str], firms: pa.Array) -> None:
        self.names, self.firms, self.parts, self.length = names, firms, [], 0

    def add(self, size: int, side: str, degree: int, firm: np.ndarray, year: int, quarter: int | None, *more: pa.Array) -> None:
        """Rows of one side, degree and period; ``firm`` holds numbers."""
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), size)
        self.parts.append(
            pa.RecordBatch.from_arrays(
                [same(side, pa.string()), same(degree, pa.int32()), self.firms.take(pa.array(firm)), same(year, pa.int32()), same(quarter, pa.int32()), *more],
                names=self.names,
            )
        )
        self.length += size

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """Everything as one batch, if there are so many rows."""
        if self.length >= least:
            yield from pa.Table.from_batches(self.parts).combine_chunks().to_batches()
            self.parts, self.length = [], 0


COLUMNS = ["side", "degree", "firm_gvkey", "year", "quarter"]
BATCH = 1 << 14


def _schema(w: Walks, more: str) -> str:
    return f"side string, degree int, firm_gvkey {w.firm_type}, year int, quarter int, {more}"


def _batches(part: Part, bytes_a_start: int) -> Iterator[np.ndarray]:
    size = starts_at_once(bytes_a_start, STARTS_AT_ONCE)
    for low in range(0, len(part.starts), size):
        yield part.starts[low : low + size]


def _cut(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of pairs of about ``ROWS_AT_ONCE`` rows."""
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]), ROWS_AT_ONCE), side="right") if len(sizes) else []
    bounds = np.unique([0, *cuts, len(sizes)])
    for low, high in zip(bounds, bounds[1:]):
        yield slice(low, high)


# -- links -----------------------------------------------------------------------


def linked_lists(w: Walks) -> DataFrame:
    """Partners at two and three hops, listed per start and period in one or several rows."""
    count, at_once = w.ends.count, w.at_once
    parts = parts_of(w.tables, count)

    def task(number: int, rows: list[Row]) -> Iterator[pa.RecordBatch]:
        part = Part(number, parts, rows, count, at_once)
        out = Buffer([*COLUMNS, "partners"], part.firms)
        for starts in _batches(part, 0):
            for group in sorted(g for g in part.groups if g[1] != NO_QUARTER):
                nodes = part.step(group).nodes
                for degree, bits in part.hops(group, starts):
                    for start, place in pairs(bits) if degree > 1 else ():
                        first, partners = lists(start, part.firms.take(pa.array(nodes[place])))
                        out.add(len(first), group[2], degree, starts[first], group[0], group[1], partners)
                        if sum(p["partners"].nbytes for p in out.parts[-1:]) > 1 << 20 or len(out.parts) >= 64:
                            yield from out.take()
        yield from out.take()

    return run(w.tables, parts, task, _schema(w, f"partners array<{w.firm_type}>"))


def linked_counts(w: Walks) -> DataFrame:
    """Numbers of partners (``n``) at two and three hops per start and period."""
    count, at_once = w.ends.count, w.at_once
    parts = parts_of(w.tables, count)

    def task(number: int, rows: list[Row]) -> Iterator[pa.RecordBatch]:
        part = Part(number, parts, rows, count, at_once)
        out = Buffer([*COLUMNS, "n"], part.firms)
        for starts in _batches(part, 0):
            for group in sorted(g for g in part.groups if g[1] != NO_QUARTER):
                for degree, bits in part.hops(group, starts):
                    if degree > 1:
                        n = np.zeros(len(starts), np.int64)
                        for start, _ in pairs(bits):
                            n += np.bincount(start, minlength=len(starts))
                        some = np.flatnonzero(n)
                        out.add(len(some), group[2], degree, starts[some], group[0], group[1], pa.array(n[some]))
            yield from out.take(BATCH)
        yield from out.take()

    return run(w.tables, parts, task, _schema(w, "n bigint"))


# -- declines --------------------------------------------------------------------


class Declines(NamedTuple):
    """Declines of packed links that are worked out by whoever reads them, and not listed before."""

    walks: Walks
    scores: DataFrame
    yearly: bool

    def _run(self, task: Callable, more: str) -> DataFrame:
        w, count, kind = self.walks, self.walks.ends.count, Annual if self.yearly else Quarterly
        parts, at_once = parts_of(w.tables, count), w.at_once

        def whole(number: int, rows: list[Row]) -> Iterator[pa.RecordBatch]:
            part = Part(number, parts, rows, count, at_once)
            yield from task(part, kind(part, rows))

        scores = packed_scores(self.scores, w.ends, ["year"] if self.yearly else ["year", "quarter"])
        return run(w.tables.unionByName(scores), parts, whole, _schema(w, more))

    def rates(self) -> DataFrame:
        """Rows and declines of every firm and period that has a row."""
        return self._run(_rates, "n bigint, declines bigint")

    def lists(self, rate: bool = False) -> DataFrame:
        """The rows themselves, listed per firm and period; ``decline_rate`` only if it is asked for."""
        pair = f"partner_gvkey:{self.walks.firm_type},scorevalue:double,lst_score:double,decline:int"
        return self._run(_Lists(rate), f"decline_rate double, rows array<struct<{pair}>>")

    def ends(self) -> DataFrame:
        """Firms and partners that have a row, per part of the firms; year and quarter are null."""
        return self._run(_ends, "is_partner boolean")


def _times(part: Part, history: Quarterly | Annual) -> Iterator[tuple]:
    """Starts, side, period, degree and the pairs of every step, in the order that fills need."""
    for starts in _batches(part, history.state_bytes):
        for side in sorted({g[2] for g in part.groups}):
            history.begin(side, len(starts))
            for year, quarter, degree, again in history.steps(side, starts):
                yield starts, side, year, quarter, degree, again


def _sums(history: Quarterly | Annual, starts: np.ndarray, year: int, quarter: int | None, degree: int, found: Iterator[tuple], passed: bool) -> np.ndarray:
    """Rows and declines of every start."""
    sums = np.zeros((2, len(starts)), np.int64)
    for start, partner in found:
        here = history.found(year, quarter, degree, start, partner)
        for total, amount in zip(sums, (here.rows, here.declines)):
            total += np.bincount(here.start, amount, len(starts)).astype(np.int64)
        if passed:
            history.passed(year, degree, start, partner)
    return sums


def _rates(part: Part, history: Quarterly | Annual) -> Iterator[pa.RecordBatch]:
    out = Buffer([*COLUMNS, "n", "declines"], part.firms)
    for starts, side, year, quarter, degree, again in _times(part, history):
        n, declines = _sums(history, starts, year, quarter, degree, again(), True)
        some = np.flatnonzero(n)
        if len(some):
            out.add(len(some), side, degree, starts[some], year, quarter, pa.array(n[some]), pa.array(declines[some]))
        yield from out.take(BATCH)
    yield from out.take()


class _Lists(NamedTuple):
    rate: bool

    def __call__(self, part: Part, history: Quarterly | Annual) -> Iterator[pa.RecordBatch]:
        series = history.series
        out = Buffer([*COLUMNS, "decline_rate", "rows"], part.firms)
        for starts, side, year, quarter, degree, again in _times(part, history):
            if self.rate:
                n, declines = _sums(history, starts, year, quarter, degree, again(), False)
                rates = declines / np.maximum(n, 1)
            for start, partner in again():
                here = history.found(year, quarter, degree, start, partner)
                for run_ in _cut(here.rows):
                    r = here.of(np.arange(run_.start, run_.stop))
                    fields = {
                        "partner_gvkey": part.firms.take(pa.array(here.partner[r.pair])),
                        "scorevalue": pa.array(series.values[r.own]),
                        "lst_score": pa.array(series.values[r.last]),
                        "decline": pa.array((series.rank[r.own] < series.rank[r.last]).astype(np.int32)),
                    }
                    first, rows = lists(here.start[r.pair], pa.StructArray.from_arrays(list(fields.values()), list(fields)))
                    rate = pa.array(rates[first]) if self.rate else pa.nulls(len(first), pa.float64())
                    out.add(len(first), side, degree, starts[first], year, quarter, rate, rows)
                    if len(r.pair) > 1 << 15 or len(out.parts) >= 64:
                        yield from out.take()
                history.passed(year, degree, start, partner)
        yield from out.take()


def _ends(part: Part, history: Quarterly | Annual) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, np.ndarray] = {}
    for starts, side, year, quarter, degree, again in _times(part, history):
        marks = found.setdefault((side, degree), np.zeros((2, part.count), bool))
        for start, partner in again():
            here = history.found(year, quarter, degree, start, partner)
            marks[0, starts[here.start]] = marks[1, here.partner] = True
            history.passed(year, degree, start, partner)
    out = Buffer([*COLUMNS, "is_partner"], part.firms)
    for (side, degree), marks in found.items():
        for is_partner, mine in zip((False, True), marks):
            firms = np.flatnonzero(mine)
            out.add(len(firms), side, degree, firms, None, None, pa.repeat(pa.scalar(is_partner), len(firms)))
            yield from out.take()
