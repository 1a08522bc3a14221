"""Name matches against scoring every pair in plain Python."""

import random
import re

import pytest
from conftest import rows

from chainrisk.operators import names as N


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            kept = row[j]
            row[j] = previous + 1 if x == y else max(row[j], row[j - 1])
            previous = kept
    return row[-1]


def ratio(a, b):
    return round(100 * (2 * common(a, b) / (len(a) + len(b)))) if a and b else 0


def token_set(a, b):
    def tokens(s):
        s = s.encode("ascii", "ignore").decode().lower()
        return set(re.sub("[^a-z0-9_]", " ", s).split())

    x, y = tokens(a), tokens(b)
    if not x or not y:
        return 0
    i = " ".join(sorted(x & y))
    c1 = (i + " " + " ".join(sorted(x - y))).strip()
    c2 = (i + " " + " ".join(sorted(y - x))).strip()
    return max(ratio(i, c1), ratio(i, c2), ratio(c1, c2))


def noisy(rng, name):
    chars = list(name)
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        at = rng.randrange(len(chars))
        action = rng.choice(["drop", "add", "swap"])
        if action == "drop" and len(chars) > 1:
            del chars[at]
        elif action == "add":
            chars.insert(at, rng.choice("abcdexyz 1"))
        else:
            chars[at] = rng.choice("abcde")
    return "".join(chars)


@pytest.mark.parametrize("salt_rows", [20_000, 7])
def test_matches_equal_all_pairs(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(N, "SALT_ROWS", salt_rows)
    rng = random.Random(11)
    parts = ["alpha", "beta", "be", "b", "group", "holdings", "micro", "microsoft", "at", "a", "aa", "b2", "österreich", "3m", "a_b"]
    a = {" ".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(150)}
    b = {noisy(rng, rng.choice(sorted(a))) for _ in range(250)} | {"", "  ", "é"}
    want = sorted(
        (x, y, token_set(x, y)) for x in a for y in b if x[:1] == y[:1] and token_set(x, y) >= 90
    )
    left = spark.createDataFrame([(x,) for x in a], "x string")
    right = spark.createDataFrame([(y,) for y in b], "y string")
    found = N.name_matches(left, "x", right, "y")
    assert sorted(rows(found, "name_a", "name_b", "score")) == want
    best = {}
    for x, y, s in want:
        best.setdefault(x, []).append((-s, y))
    top = sorted((x, y, -s) for x, pairs in best.items() for s, y in sorted(pairs)[:5])
    assert sorted(rows(N.best_matches(found), "name_a", "name_b", "score")) == top


def test_one_letter_is_not_scored_pair_by_pair(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(400)]
    names = [("x" + rng.choice(words) + " " + rng.choice(words) + " holdings",) for _ in range(600)]
    profile = N._profile(spark.createDataFrame(names, "n string"), "n").cache()
    n = profile.count()
    assert N.candidate_pairs(profile, profile).count() < n * n / 3
    scored = spark.sparkContext.accumulator(0)
    original = N.common_subsequence

    def counting(left, right):
        @N.F.pandas_udf("string")
        def count(values: N.pd.Series) -> N.pd.Series:
            scored.add(len(values))
            return values

        return original(count(left), right)

    monkeypatch.setattr(N, "common_subsequence", counting)
    N.score_pairs(N.candidate_pairs(profile, profile), profile, profile).count()
    assert 0 < scored.value < n * n / 20


def test_top_matches_equal_the_best_of_all_matches(spark):
    rng = random.Random(5)
    parts = ["alpha", "beta", "be", "group", "holdings", "micro", "microsoft", "at", "a", "b2"]
    a = {" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(80)} | {"alpha " + "x" * 120, "b" * 150}
    b = {noisy(rng, rng.choice(sorted(a))) for _ in range(120)} | {"alpha " + "x" * 119 + "y", "b" * 149}
    left = spark.createDataFrame([(x,) for x in a], "x string")
    right = spark.createDataFrame([(y,) for y in b], "y string")
    want = rows(N.best_matches(N.name_matches(left, "x", right, "y"), 1))
    assert want and rows(N.top_matches(left, "x", right, "y")) == want


def test_numbered_names_link_without_comparing_all_pairs(spark, monkeypatch):
    firms = spark.range(1500).selectExpr("concat('Firm ', id, ' Inc.') AS coname", "id AS gvkey", "DATE '2000-01-01' AS FNDATE", "DATE '2001-01-01' AS LNDATE")
    names = spark.range(1500).selectExpr("concat('firm ', id) AS name")
    made = []
    original = N.candidate_pairs

    def counted(*given):
        pairs = original(*given)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(N, "candidate_pairs", counted)
    table = N.matched_link_table(firms, names)
    assert rows(table, "coname", "gvkey") == sorted((f"firm {i}", i) for i in range(1500))
    assert sum(made) <= 4 * 1500
