"""Fixed-effect regressions against dummy variables in numpy."""

import numpy as np
import pytest

from chainrisk.operators import regression as R


def panel(seed, units=40, periods=9, keep=0.7):
    rng = np.random.default_rng(seed)
    out = []
    unit, time = rng.normal(size=units) * 3, rng.normal(size=periods) * 2
    for i in range(units):
        for t in range(periods):
            if rng.random() > keep:
                continue
            for _ in range(1 + (rng.random() < 0.1)):  # some firms repeat in a period
                a, b = rng.normal() + unit[i], rng.normal() * 5 + time[t] + 100
                y = 1.5 * a - 0.2 * b + unit[i] + time[t] + rng.normal()
                out.append((i, t, *map(float, (a, b, i % 2, 2 * a - 1, y))))
    out += [(1000 + i, 0, 1.0, 2.0, 0.0, 1.0, 3.0) for i in range(3)]  # firms seen once
    return out


def dummies(values):
    levels = sorted(set(values))
    return np.array([[v == level for level in levels] for v in values], dtype=float)


def by_hand(data):
    f = [r[0] for r in data]
    t = [r[1] for r in data]
    x = np.array([[r[2], r[3]] for r in data])
    y = np.array([r[6] for r in data])
    effects = np.hstack([dummies(f), dummies(t)[:, 1:]])

    def rest(v):
        return v - effects @ np.linalg.lstsq(effects, v, rcond=None)[0]

    xd, yd = rest(x), rest(y)
    inverse = np.linalg.inv(xd.T @ xd)
    beta = inverse @ xd.T @ yd
    e = yd - xd @ beta
    n, k = len(y), 2 + len(set(f)) + len(set(t)) - 1
    meat = np.zeros((2, 2))
    for sign, groups in ((1, f), (1, t), (-1, list(zip(f, t)))):
        sums = dummies(groups).T @ (xd * e[:, None])
        g = len(sums)
        meat += sign * (n - 1) / (n - k) * g / (g - 1) * sums.T @ sums
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    r2 = 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))
    return beta, se, n, n - k, r2, 1 - e @ e / (yd @ yd)


SCHEMA = "firm_gvkey int, year int, a double, b double, fixed double, copy double, y double"


@pytest.mark.parametrize("parts", [1, 7])
def test_unbalanced_panel(spark, parts):
    data = panel(3)
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    got = R.fit(df, R.Model("m", "y", ("a", "b")))
    beta, se, n, df_, r2, within = by_hand(data)
    assert got.estimate == pytest.approx(beta)
    assert got.error == pytest.approx(se)
    assert (got.n, got.df) == (n, df_)
    assert got.r2 == pytest.approx(r2)
    assert got.r2_within == pytest.approx(within)


def test_demeaned_columns_have_no_group_means(spark):
    rows = spark.createDataFrame(panel(5), SCHEMA)
    flat, levels, free = R.demean(rows, ["a", "y"], "firm_gvkey", "year")
    assert (levels, free) == (9, 8)
    for key in ("firm_gvkey", "year"):
        worst = flat.groupBy(key).avg("a", "y").toPandas()[["avg(a)", "avg(y)"]].abs().max().max()
        assert worst < 1e-9


def test_collinear_terms_are_left_out(spark):
    df = spark.createDataFrame(panel(3), SCHEMA)
    got = R.fit(df, R.Model("m", "y", ("a", "fixed", "b", "copy")))
    alone = R.fit(df, R.Model("m", "y", ("a", "b")))
    assert np.isnan(got.estimate[[1, 3]]).all()
    assert got.estimate[[0, 2]] == pytest.approx(alone.estimate)
    assert got.error[[0, 2]] == pytest.approx(alone.error)
    table = R.model_table(spark, [got]).collect()
    assert sum(r["estimate"] is None for r in table) == 2


def test_distributed_solution_equals_the_dense_one(spark, monkeypatch):
    df = spark.createDataFrame(panel(3), SCHEMA)
    dense = R.fit(df, R.Model("m", "y", ("a", "b")))
    monkeypatch.setattr(R, "DENSE_LEVELS", 4)
    free = R.fit(df, R.Model("m", "y", ("a", "b")))
    assert free.estimate == pytest.approx(dense.estimate, rel=1e-6)
    assert free.error == pytest.approx(dense.error, rel=1e-6)
    assert (free.df, free.periods) == (dense.df, dense.periods)


def test_more_than_five_thousand_time_levels(spark):
    """The levels' effects are taken out by the normal equations of numpy."""
    rng = np.random.default_rng(11)
    levels, units = 5_200, 300
    t = np.concatenate([np.arange(levels), rng.integers(0, levels, 7_000)])
    u = rng.integers(0, units, len(t))
    a = rng.normal(size=len(t)) + u % 7 + t % 5
    y = 0.5 * a + u % 11 - t % 3 + rng.normal(size=len(t))
    d = np.zeros((len(t), units))
    d[np.arange(len(t)), u] = 1
    n_t = np.bincount(t, minlength=levels)

    def rest(v):
        """Level means out, then what the level-free unit dummies explain."""
        out = lambda m: m - (np.stack([np.bincount(t, c, levels) for c in m.T], 1) / n_t[:, None])[t]
        return out(v) - out(d) @ np.linalg.lstsq(out(d), out(v), rcond=None)[0]

    x, z = rest(np.stack([a, y], 1)).T
    rows = [(int(i), int(j), float(p), 0.0, 0.0, 0.0, float(q)) for i, j, p, q in zip(u, t, a, y)]
    got = R.fit(spark.createDataFrame(rows, SCHEMA), R.Model("m", "y", ("a",)))
    assert got.periods == levels and got.df == len(t) - (1 + units + levels - 1)
    assert got.estimate[0] == pytest.approx((x @ z) / (x @ x), rel=1e-5)


def test_unconnected_panels_have_a_free_effect_each(spark):
    """Two panels that share no firm and no year: one more degree of freedom, as two time effects fall away."""
    data = panel(3) + [(5000 + r[0], 50 + r[1], *r[2:]) for r in panel(4)]
    got = R.fit(spark.createDataFrame(data, SCHEMA), R.Model("m", "y", ("a", "b")))
    units, periods = len({r[0] for r in data}), len({r[1] for r in data})
    assert got.df == len(data) - (2 + units + periods - 2)


def test_indefinite_variance_is_repaired():
    fixed = R.semidefinite(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert fixed == pytest.approx(np.full((2, 2), 1.5))


def test_no_fit_without_degrees_of_freedom(spark):
    rows = [(i, 0, float(i), 1.0, 0.0, 0.0, float(i)) for i in range(5)]
    got = R.fit(spark.createDataFrame(rows, SCHEMA), R.Model("m", "y", ("a",)))
    assert got.df <= 0 and np.isnan(got.r2)


def test_empty_sample(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.fit(df, R.Model("m", "y", ("a",))).n == 0


@pytest.mark.parametrize(
    "t, df, p",
    [(2.0, 10, 0.0733880), (12.706205, 1, 0.05), (1.959964, 10_000_000, 0.05), (0.0, 5, 1.0), (-3.0, 30, 0.0053903)],
)
def test_student_tail(t, df, p):
    assert R.student_p(t, df) == pytest.approx(p, rel=1e-4)
