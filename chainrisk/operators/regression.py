"""Two-way fixed-effect least squares with two-way clustered errors.

The firm effect is removed by firm means and the time effect by regressing on
time dummies, through their cross moments.  With at most DENSE_LEVELS time levels
those moments form a small matrix, and the demeaning is exact after two passes over
the data, also for unbalanced panels.  With more levels the same equations are
solved by conjugate gradients whose vectors stay distributed, one table row per
level.  Only matrices of size (DENSE_LEVELS) and (regressors) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainrisk.sources.staging import stage

DENSE_LEVELS = 1_000
TOLERANCE = 1e-12  # of the squared residual against the right-hand side
COLLINEAR = 1e-9


@dataclass(frozen=True)
class Model:
    """What to regress: outcome, regressors, and the two absorbed effects."""

    name: str
    outcome: str
    regressors: tuple[str, ...]
    unit: str = "firm_gvkey"
    time: str = "year"


@dataclass(frozen=True)
class Fit:
    model: Model
    estimate: np.ndarray
    error: np.ndarray
    t: np.ndarray
    p: np.ndarray
    n: int
    units: int
    periods: int
    df: int
    r2: float
    r2_within: float


def student_p(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t, by quadrature over the angle."""
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    start = math.atan(abs(t) / math.sqrt(df))
    stop = min(math.pi / 2, start + 60 / math.sqrt(df))
    nodes, weights = np.polynomial.legendre.leggauss(200)
    half = (stop - start) / 2
    area = half * float(np.sum(weights * np.cos(start + half * (nodes + 1)) ** (df - 1)))
    whole = math.sqrt(math.pi) * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2))
    return min(1.0, 2 * area / whole)


def _cells(rows: DataFrame, columns: Sequence[str], unit: str, time: str) -> DataFrame:
    """Rows per unit and level (n), and the sums of the columns."""
    return rows.groupBy(unit, time).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in columns]).alias("sums")
    )


def _time_moments(
    cells: DataFrame, levels: Sequence, width: int, unit: str, time: str
) -> tuple[np.ndarray, np.ndarray]:
    """Cross moments of the time dummies, and with the columns, firm means removed.

    A unit is one row with at most as many cells as there are time levels.
    Each task adds up its units cell by cell; the tasks' matrices are summed in Spark.
    """
    place = {level: i for i, level in enumerate(levels)}
    size = len(levels)
    units = cells.groupBy(unit).agg(
        F.collect_list(F.struct(F.col(time).alias("t"), "n", "sums")).alias("cells")
    ).select("cells.t", "cells.n", F.flatten("cells.sums").alias("sums"))

    def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, cross = np.zeros((size, size)), np.zeros((size, width))
        for batch in batches:
            for times, n, flat in zip(batch["t"], batch["n"], batch["sums"]):
                at = np.array([place[t] for t in times])
                n, sums = np.asarray(n, dtype=float), np.asarray(flat).reshape(len(at), width)
                gram[at, at] += n
                gram[np.ix_(at, at)] -= np.outer(n, n / n.sum())
                cross[at] += sums - np.outer(n / n.sum(), sums.sum(axis=0))
        yield pd.DataFrame({"i": range(size), "row": list(np.hstack([gram, cross]))})

    parts = units.mapInPandas(add_up, "i int, row array<double>")
    summed = (
        parts.select("i", F.posexplode("row").alias("j", "v"))
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
    )
    out = np.zeros((size, size + width))
    for r in summed.collect():
        out[r["i"], r["j"]] = r["v"]
    return out[:, :size], out[:, size:]


def _scaled_sum(a: str, b: str, factors: np.ndarray) -> Column:
    """a + factor * b, column by column of two array columns."""
    scale = F.array(*[F.lit(float(f)) for f in factors])
    return F.zip_with(a, F.zip_with(b, scale, lambda x, f: x * f), lambda x, y: x + y)


def _array_sums(name: str, width: int, weight: Column | None = None) -> Column:
    value = lambda j: F.col(name)[j] if weight is None else F.col(name)[j] * weight
    return F.array(*[F.sum(value(j)) for j in range(width)])


def _dots(df: DataFrame, a: str, b: str, width: int) -> np.ndarray:
    row = df.agg(*[F.sum(F.col(a)[j] * F.col(b)[j]).alias(f"d{j}") for j in range(width)]).first()
    return np.array([row[j] or 0.0 for j in range(width)])


def _without_unit_part(cells: DataFrame, vectors: DataFrame, name: str, unit: str, time: str, width: int) -> DataFrame:
    """The normal equations' matrix times a vector of the levels, as (time, product)."""
    here = cells.select(unit, time, "n").join(vectors.select(time, name), time)
    means = here.groupBy(unit).agg(
        F.sum("n").alias("rows"), _array_sums(name, width, F.col("n")).alias("total")
    ).select(unit, F.transform("total", lambda x: x / F.col("rows")).alias("mean"))
    left = here.join(means, unit).select(
        time, F.zip_with(name, "mean", lambda x, m: (x - m)).alias("v"), "n"
    )
    return left.groupBy(time).agg(_array_sums("v", width, F.col("n")).alias("product"))


def _distributed_effects(cells: DataFrame, width: int, unit: str, time: str) -> DataFrame:
    """Time effects by conjugate gradients, all columns at once: (time, x array).

    Raises if a column has not converged after as many rounds as it may need.
    """
    totals = cells.groupBy(unit).agg(F.sum("n").alias("rows"), _array_sums("sums", width).alias("total"))
    right = cells.join(totals, unit).select(
        time,
        F.zip_with("sums", "total", lambda s, t: s - t * F.col("n") / F.col("rows")).alias("v"),
    ).groupBy(time).agg(_array_sums("v", width).alias("r"))
    state = stage(right.select(time, F.transform("r", lambda x: x * 0).alias("x"), "r", F.col("r").alias("p")), "cg")
    norms = _dots(state, "r", "r", width)
    limit = TOLERANCE * np.maximum(norms, 1e-300)
    # Exact arithmetic ends within one round per level; rounding may take some more.
    for _ in range(2 * state.count() + 10):
        if (norms <= limit).all():
            break
        applied = stage(
            state.join(_without_unit_part(cells, state, "p", unit, time, width), time), "cg-applied"
        )
        curve = _dots(applied, "p", "product", width)
        live = (norms > limit) & (curve > 0)
        step = np.where(live, norms / np.where(live, curve, 1.0), 0.0)
        moved = applied.select(
            time, _scaled_sum("x", "p", step).alias("x"), _scaled_sum("r", "product", -step).alias("r"), "p"
        )
        after = _dots(moved, "r", "r", width)
        if not live.any():
            break
        turn = np.where(live, after / np.where(live, norms, 1.0), 0.0)
        state = stage(moved.select(time, "x", "r", _scaled_sum("r", "p", turn).alias("p")), "cg")
        norms = np.where(live, after, norms)
    if (norms > limit).any():
        raise ArithmeticError(f"time effects have not converged: squared residuals {norms} above {limit}")
    return state.select(time, "x")


def _linked_parts(cells: DataFrame, unit: str, time: str) -> int:
    """Number of connected parts of the graph of units and levels."""
    labels = stage(cells.select(time).distinct().withColumn("label", F.xxhash64(time)), "part-labels")
    while True:
        by_unit = cells.join(labels, time).groupBy(unit).agg(F.min("label").alias("low"))
        lower = stage(cells.join(by_unit, unit).groupBy(time).agg(F.min("low").alias("label")), "part-labels")
        old = labels.select(time, F.col("label").alias("old"))
        if lower.join(old, time).where("label <> old").isEmpty():
            return lower.select("label").distinct().count()
        labels = lower


def demean(
    rows: DataFrame, columns: Sequence[str], unit: str, time: str
) -> tuple[DataFrame, int, int]:
    """Columns with both effects removed, named as before; keys are kept.

    Also the number of time levels, and how many of their effects are free once
    the unit effects are in: levels minus connected parts of units and levels.
    """
    kind = dict(rows.dtypes)[time]
    cells = stage(_cells(rows, columns, unit, time), "panel-cells")
    count = cells.agg(F.count_distinct(time)).first()[0]
    if count <= DENSE_LEVELS:
        levels = sorted(r[0] for r in cells.select(time).distinct().collect())
        gram, cross = _time_moments(cells, levels, len(columns), unit, time)
        # The dummies of a connected part sum to one, so the moments are singular: cut those directions.
        effects = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ cross
        free = int(np.linalg.matrix_rank(gram, tol=1e-9 * max(np.abs(gram).max(), 1e-300), hermitian=True))
        table = pd.DataFrame(effects, columns=[f"{c}_effect" for c in columns]).assign(**{time: levels})
        schema = [f"{c}_effect double" for c in columns] + [f"{time} {kind}"]
        effect_table = rows.sparkSession.createDataFrame(table, ", ".join(schema))
    else:
        solved = _distributed_effects(cells, len(columns), unit, time)
        effect_table = solved.select(time, *[F.col("x")[j].alias(f"{c}_effect") for j, c in enumerate(columns)])
        free = count - _linked_parts(cells, unit, time)
    adjusted = rows.join(effect_table, time).selectExpr(
        unit, time, *[f"`{c}` - `{c}_effect` AS `{c}`" for c in columns]
    )
    means = adjusted.groupBy(unit).agg(*[F.expr(f"avg(`{c}`) AS `{c}_mean`") for c in columns])
    flat = adjusted.join(means, unit).selectExpr(
        unit, time, *[f"`{c}` - `{c}_mean` AS `{c}`" for c in columns]
    )
    return flat, count, free


def semidefinite(variance: np.ndarray) -> np.ndarray:
    """A variance matrix with its negative eigenvalues set to zero."""
    value, vector = np.linalg.eigh((variance + variance.T) / 2)
    return (vector * np.maximum(value, 0.0)) @ vector.T


def _gram_columns(columns: Sequence[str]) -> list[Column]:
    return [
        F.expr(f"sum(`{a}` * `{b}`) AS g_{i}_{j}")
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i <= j
    ]


def _matrix(row, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = row[f"g_{i}_{j}"] or 0.0
    return out


def _independent(gram: np.ndarray) -> list[int]:
    """Indices of regressors that are no combination of earlier ones."""
    kept: list[int] = []
    for i in range(len(gram)):
        if gram[i, i] <= 0:
            continue
        rest = gram[i, i]
        if kept:
            inner = gram[np.ix_(kept, kept)]
            cross = gram[kept, i]
            rest -= cross @ np.linalg.lstsq(inner, cross, rcond=None)[0]
        if rest > COLLINEAR * gram[i, i]:
            kept.append(i)
    return kept


def fit(data: DataFrame, model: Model, staged: bool = False) -> Fit:
    """Estimate one model; collinear regressors get NaN.

    The rows are read several times: they are written once first, unless the
    caller says that ``data`` is a plain scan already (``staged``).
    """
    unit, time, xs = model.unit, model.time, list(model.regressors)
    columns = [model.outcome, *xs]
    rows = data.selectExpr(unit, time, *[f"double(`{c}`) AS `{c}`" for c in columns]).dropna("any")
    if not staged:
        rows = stage(rows, "panel-rows")
    k = len(xs)
    nothing = np.full(k, np.nan)
    shape = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(unit).alias("units"),
        F.var_pop(model.outcome).alias("variance"),
        *[F.expr(f"sum(`{x}` * `{x}`) AS raw_{x}") for x in xs],
    ).first()
    n = shape["n"]
    if n == 0:
        return Fit(model, nothing, nothing, nothing, nothing, 0, 0, 0, 0, np.nan, np.nan)
    flat, periods, free = demean(rows, columns, unit, time)
    flat = stage(flat, "panel-demeaned")
    whole = _matrix(flat.agg(*_gram_columns([*xs, model.outcome])).first(), k + 1)
    scale = np.diag(whole)[:k]
    usable = [i for i, x in enumerate(xs) if scale[i] > COLLINEAR * shape[f"raw_{x}"]]
    kept = [usable[i] for i in _independent(whole[np.ix_(usable, usable)])] if usable else []

    estimate, error = nothing.copy(), nothing.copy()
    inverse = np.linalg.inv(whole[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    beta = inverse @ whole[kept, k]
    estimate[kept] = beta
    terms = [xs[i] for i in kept]

    residual = " - ".join(
        [f"`{model.outcome}`", *[f"({float(b)!r}D * `{x}`)" for b, x in zip(beta, terms)]]
    )
    scored = flat.selectExpr(unit, time, *terms, f"{residual} AS _e").selectExpr(
        unit, time, *[f"`{x}` * _e AS _s{i}" for i, x in enumerate(terms)]
    )
    direction = np.zeros(k + 1)
    direction[kept], direction[k] = -beta, 1.0
    ssr = max(float(direction @ whole @ direction), 0.0)
    df = n - (len(kept) + shape["units"] + free)

    if kept and df > 0:
        names = [f"_s{i}" for i in range(len(kept))]
        sums = scored.groupingSets([[unit], [time], [unit, time]], unit, time).agg(
            *[F.sum(c).alias(c) for c in names], F.grouping_id().alias("level")
        )
        meats = sums.groupBy("level").agg(F.count(F.lit(1)).alias("groups"), *_gram_columns(names))
        meat = np.zeros((len(kept), len(kept)))
        for r in meats.collect():
            sign = -1.0 if r["level"] == 0 else 1.0
            groups = r["groups"]
            if groups > 1:
                factor = sign * (n - 1) / df * groups / (groups - 1)
                meat += factor * _matrix(r, len(kept))
        variance = np.diag(semidefinite(inverse @ meat @ inverse))
        error[kept] = np.sqrt(np.where(variance > 0, variance, np.nan))
    with np.errstate(invalid="ignore", divide="ignore"):
        t = estimate / error
    p = np.array([student_p(v, df) for v in t])
    total, within = shape["variance"] * n, whole[k, k]
    return Fit(
        model, estimate, error, t, p, n, shape["units"], periods, df,
        1 - ssr / total if total > 0 and df > 0 else np.nan,
        1 - ssr / within if within > 0 and df > 0 else np.nan,
    )


def fit_all(jobs: Sequence[Callable[[], Sequence[Fit]]], at_once: int = 4) -> list[Fit]:
    """Run independent estimations side by side; results keep the given order.

    One fit is a chain of small jobs, so a few of them together keep the
    executors busy.
    """
    with ThreadPoolExecutor(at_once) as pool:
        return [f for fits in pool.map(lambda job: job(), jobs) for f in fits]


def _plain(value: float) -> float | None:
    return None if value is None or not math.isfinite(value) else float(value)


def stars(p: float) -> str:
    """Significance marks at 1, 5 and 10 percent."""
    if not math.isfinite(p):
        return ""
    return "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""


def coefficient_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """Long table: one row per model and term."""
    rows = [
        (
            f.model.name, term, _plain(f.estimate[i]), _plain(f.error[i]), _plain(f.t[i]),
            _plain(f.p[i]), stars(f.p[i]),
        )
        for f in fits
        for i, term in enumerate(f.model.regressors)
    ]
    return spark.createDataFrame(
        rows,
        "model string, term string, estimate double, se double, t double, p double, stars string",
    )


def fit_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    rows = [
        (f.model.name, f.n, f.units, f.periods, f.df, _plain(f.r2), _plain(f.r2_within))
        for f in fits
    ]
    return spark.createDataFrame(
        rows,
        "model string, n bigint, units bigint, periods bigint, df bigint, r2 double, r2_within double",
    )


def model_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """Coefficients and fit of several models side by side, long."""
    return coefficient_table(spark, fits).join(fit_table(spark, fits), "model")
