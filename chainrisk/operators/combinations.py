"""Suppliers and customers of firms by quarter, put together from annual sales.

A sale goes to the part of its buyer and to that of its seller as a few packed bytes, and each
part gets the scores of all firms: what a quarter adds to a sale is looked up in the task and
not shuffled.  Shuffled bytes grow with the sales, and with the firms times the parts.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Its task functions go to the tasks whole, as those of ``walks``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORED, SOLD = 0, 1
QUARTERS_OF = (1, 2, 3, 4)
METRICS_OF = ("pol", "covid", "cc")
#: Firm and partner of a sale by side.
ENDS = {"supplier": ("GVKEY2", "GVKEY1"), "customer": ("GVKEY1", "GVKEY2")}
#: Sales that a task packs, sales of a part, and list entries of a result, about as many at a time.
SALES_PACKED = 1 << 20
SALES_A_PART = 1 << 21
ENTRIES_AT_ONCE = 1 << 17
PACKED = "part int, kind int, side string, year int, firm binary, partner binary, amount binary"
COLUMNS = [f"{m}_{q}" for q in QUARTERS_OF for m in METRICS_OF] + [f"sale_t_{s}" for s in ENDS]


class AnnualSales(NamedTuple):
    """Rows of ``scored_sales`` and the ``firm_years`` that they were scored with."""

    scored: DataFrame
    firm_years: DataFrame


def part_of(firm: np.ndarray, parts: int) -> np.ndarray:
    mixed = firm.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Numbers with NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _wholes(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte, as few bytes as the largest takes."""
    low = int(values.min(initial=0))
    return low.to_bytes(8, "little", signed=True) + zlib.compress((values - low).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _whole(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob[8:]), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64) + int.from_bytes(blob[:8], "little", signed=True)


def _real(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<f8").ravel()


def _reals(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<f8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def _together(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, length = [], 0
    for batch in batches:
        held.append(batch)
        length += batch.num_rows
        if length >= most:
            yield pa.Table.from_batches(held)
            held, length = [], 0
    if length:
        yield pa.Table.from_batches(held)


def _packed_sales(sales: DataFrame, parts: int) -> DataFrame:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, SALES_PACKED):
            year, amount = table["year"].to_numpy(), _floats(table["sale_cs"])
            for side, ends in ENDS.items():
                firm, partner = (table[c].to_numpy() for c in ends)
                part = part_of(firm, parts)
                order = np.lexsort((partner, firm, year, part))
                group = np.flatnonzero(np.diff(part[order], prepend=-1) | np.diff(year[order], prepend=-1))
                rows = []
                for mine in np.split(order, group[1:]):
                    first = mine[0]
                    rows.append((int(part[first]), SOLD, side, int(year[first]), _wholes(firm[mine]), _wholes(partner[mine]), _reals(amount[mine])))
                yield _batch(rows)

    narrow = sales.select(*[F.col(c).cast("bigint").alias(c) for c in ("GVKEY1", "GVKEY2")], F.col("year").cast("int").alias("year"), F.col("sale_cs").cast("double").alias("sale_cs"))
    return narrow.mapInArrow(pack, PACKED)


def _packed_scores(firm_years: DataFrame, parts: int) -> DataFrame:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, SALES_PACKED):
            year, firm = table["year"].to_numpy(), table["firm_gvkey"].to_numpy()
            for one in np.unique(year):
                mine = np.flatnonzero(year == one)
                mine = mine[np.argsort(firm[mine])]
                values = np.concatenate([_floats(table[c])[mine] for c in COLUMNS])
                yield _batch([(0, SCORED, "", int(one), _wholes(firm[mine]), b"", _reals(values))])

    known = firm_years.filter(F.col("firm_gvkey").isNotNull() & F.col("year").isNotNull())
    rows = known.select(F.col("firm_gvkey").cast("bigint").alias("firm_gvkey"), F.col("year").cast("int").alias("year"), *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    once = rows.mapInArrow(pack, PACKED)
    return once.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


class _Year:
    """Scores and sales totals of all firms in a year."""

    def __init__(self, blobs: list[tuple]) -> None:
        firms = [_whole(firm) for firm, _ in blobs] or [np.zeros(0, np.int64)]
        values = [_real(amount).reshape(len(COLUMNS), -1) for _, amount in blobs] or [np.zeros((len(COLUMNS), 0))]
        order = np.argsort(np.concatenate(firms))
        self.firms = np.concatenate(firms)[order]
        # One more column of unknown values for firms without any.
        self.values = np.concatenate([*(v for v in values), np.full((len(COLUMNS), 1), np.nan)], axis=1)
        self.values = self.values[:, np.append(order, len(order))]

    def places(self, firms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.firms, firms)
        found = np.append(self.firms, 0)[at] == firms
        return np.where(found & (at < len(self.firms)), at, len(self.firms))

    def scores(self, quarter: int, at: np.ndarray) -> np.ndarray:
        first = QUARTERS_OF.index(quarter) * len(METRICS_OF)
        return self.values[first : first + len(METRICS_OF), at]

    def totals(self, side: str, at: np.ndarray) -> np.ndarray:
        return self.values[COLUMNS.index(f"sale_t_{side}"), at]


def _distinct(firm: np.ndarray, partner: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the distinct rows, ordered by firm and partner."""
    order = np.lexsort((*np.nan_to_num(scores, nan=np.inf), partner, firm))
    new = np.ones(len(order), bool)
    same = (np.diff(firm[order]) == 0) & (np.diff(partner[order]) == 0)
    for row in scores:
        a, b = row[order][1:], row[order][:-1]
        same &= (a == b) | (np.isnan(a) & np.isnan(b))
    new[1:] = ~same
    return order[new]


def _listed(firms: np.ndarray, firm: np.ndarray, partner: np.ndarray, scores: np.ndarray) -> pa.ListArray:
    """Partners with their scores of each of the firms; both are in order of the firm."""
    bounds = np.append(np.searchsorted(firm, firms), np.searchsorted(firm, firms[-1], side="right"))
    inside = slice(bounds[0], bounds[-1])
    fields = [pa.array(partner[inside]), *(pa.array(row[inside], from_pandas=True) for row in scores)]
    rows = pa.StructArray.from_arrays(fields, ["gvkey", *METRICS_OF])
    return pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), rows)


def _quarters(year: int, known: _Year, sold: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    for quarter in QUARTERS_OF:
        sides, universe = {}, []
        for side, (firm, partner, firm_at, partner_at, share) in sold.items():
            kept = np.flatnonzero(~np.isnan(known.scores(quarter, firm_at)).any(axis=0))
            scores = known.scores(quarter, partner_at[kept]) * share[kept]
            rows = _distinct(firm[kept], partner[kept], scores)
            sides[side] = firm[kept][rows], partner[kept][rows], scores[:, rows]
            universe.append(sides[side][0])
        firms = np.unique(np.concatenate(universe))
        if not len(firms):
            continue
        entries = sum(np.searchsorted(f, firms, side="right") for f, _, _ in sides.values())
        cuts = np.unique(np.searchsorted(entries, np.arange(0, int(entries[-1]) + 1, ENTRIES_AT_ONCE)))
        for mine in np.split(firms, cuts[1:]):
            if len(mine):
                own = known.scores(quarter, known.places(mine))
                same = lambda value, size=len(mine): pa.array(np.full(size, value, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine), same(year), same(quarter), *(pa.array(s) for s in own), *(_listed(mine, *sides[s]) for s in ENDS)],
                    names=["firm_gvkey", "year", "quarter", *(f"firm_{m}" for m in METRICS_OF), "supplier", "customer"],
                )


def _combine(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for year in sorted({r[2] for r in rows if r[0] == SOLD}):
        known = _Year([(r[3], r[5]) for r in rows if r[:1] == (SCORED,) and r[2] == year])
        sold = {}
        for side in ENDS:
            mine = [r for r in rows if r[0] == SOLD and r[1] == side and r[2] == year]
            firm, partner = (np.concatenate([np.zeros(0, np.int64), *(_whole(r[k]) for r in mine)]) for k in (3, 4))
            amount = np.concatenate([np.zeros(0), *(_real(r[5]) for r in mine)])
            firm_at = known.places(firm)
            total = known.totals(side, firm_at)
            share = amount / np.where(total == 0, np.nan, total)
            sold[side] = firm, partner, firm_at, known.places(partner), share
        yield from _quarters(year, known, sold)


def listed_sides(sales: AnnualSales) -> DataFrame:
    """Every firm-quarter with its scores and its distinct suppliers and customers, listed."""
    cores = sales.scored.sparkSession.sparkContext.defaultParallelism
    count = sales.scored.count()
    parts = max(1, min(2 * cores, -(-count // 64)), -(-2 * count // SALES_A_PART))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[0] != part and held:
                    yield from _combine(held)
                    held = []
                part = row[0]
                held.append(row[1:])
        if held:
            yield from _combine(held)

    rows = _packed_sales(sales.scored, parts).unionByName(_packed_scores(sales.firm_years, parts))
    entry = "array<struct<gvkey:bigint,pol:double,covid:double,cc:double>>"
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(
        task,
        f"firm_gvkey bigint, year int, quarter int, firm_pol double, firm_covid double, firm_cc double, supplier {entry}, customer {entry}",
    )
