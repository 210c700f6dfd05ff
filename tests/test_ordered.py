"""Orders over ranges against plain lists; tails of Student's distribution against integration."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import aggregate as A, joins as J, ordered as O, rank as R, sampling as N


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, *range(12)]), rng.random() if i % 9 else None, rng.random() < 0.4) for i in range(400)]
    return data, spark.createDataFrame(data, "id long, k int, p double, y boolean").repartition(5)


def test_placed(spark, rows):
    data, df = rows
    got = {r["id"]: (r["position"], r["before"]) for r in O.placed(df, [F.col("k").desc_nulls_last(), F.col("id")], sums={"id": "before"}).collect()}
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: (n, sum(x[0] for x in order[:n])) for n, r in enumerate(order)}
    assert O.placed(df.limit(0), [F.col("id")]).count() == 0


def test_least_after(spark, rows):
    data, df = rows
    got = {r["id"]: r["low"] for r in O.least_after(df.where("p is not null"), [F.col("p"), F.col("id")], "id", "low").collect()}
    order = sorted((r for r in data if r[2] is not None), key=lambda r: (r[2], r[0]))
    assert got == {r[0]: min(x[0] for x in order[n:]) for n, r in enumerate(order)}


def test_quantiles(spark, rows):
    data, df = rows
    row = O.quantiles(df, "k", {"a": 0.0, "b": 0.33, "c": 0.5, "d": 1.0}).first()
    assert list(row) == pytest.approx(np.quantile([r[1] for r in data if r[1] is not None], [0, 0.33, 0.5, 1]).tolist())
    assert list(O.quantiles(df.limit(0), "k", {"a": 0.5}).first()) == [None]


def test_false_discovery_rates(spark, rows):
    data, df = rows
    got = {r["id"]: r["fdr"] for r in A.benjamini_hochberg(df, "p", "id").collect()}
    order = sorted((r[2], r[0]) for r in data if r[2] is not None)
    low, want = 1.0, {}
    for n in range(len(order), 0, -1):
        low = min(low, order[n - 1][0] * len(order) / n)
        want[order[n - 1][1]] = low
    assert got == pytest.approx(want)


def test_auc_and_ranks(spark, rows):
    data, df = rows
    have = [(r[1], r[3]) for r in data if r[1] is not None]
    pairs = [(a, b) for a, x in have if x for b, y in have if not y]
    assert R.auc(df, "k", "y").first()["auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert R.auc(df.where("y"), "k", "y").first()["auc"] is None
    got = {r["id"]: r["avg_rank"] for r in R.average_ranks(df, "k").collect()}
    order = sorted(-1 if r[1] is None else r[1] for r in data)
    where = {v: [n for n, x in enumerate(order, 1) if x == v] for v in set(order)}
    assert got == {r[0]: sum(w) / len(w) for r in data for w in [where[-1 if r[1] is None else r[1]]]}


def test_dense_index_and_places(spark, rows):
    data, df = rows
    got = {(r["k"], r["id"]): r["index"] for r in J.dense_index(df.unionByName(df), "k", "id").collect()}
    assert got == {(r[1], r[0]): sum(x[1] == r[1] and x[0] < r[0] for x in data) for r in data}
    got = {r["id"]: r["place"] for r in N.ranked_last_missing(df, "k", "id").collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0])), 1)}


def test_t_tail_by_integration():
    for df in (1.0, 2.5, 7.0, 40.0):
        for t in (0.0, 0.3, 1.7, 4.0):
            x = np.linspace(0, abs(t), 20001)
            y = (1 + x * x / df) ** (-(df + 1) / 2) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
            area = (y[:-1] + y[1:]).sum() / 2 * (x[1] - x[0])
            assert A.t_tail(t, df)[0] == pytest.approx(1 - 2 * area, abs=1e-7)
    many = A.t_tail(np.array([0.3, 4.0, -4.0]), np.array([2.5, 7.0, 7.0]))
    assert many.tolist() == pytest.approx([A.t_tail(0.3, 2.5)[0], *[A.t_tail(4.0, 7.0)[0]] * 2])


def test_welch_by_hand(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=9), rng.normal(0.7, 2, size=14)
    stats = spark.createDataFrame([(9, float(a.mean()), float(a.var(ddof=1)), 14, float(b.mean()), float(b.var(ddof=1))), (1, 2.0, None, 5, 1.0, 0.1), (3, 1.0, 0.0, 3, 1.0, 0.0)], "n_a long, mean_a double, var_a double, n_b long, mean_b double, var_b double")
    got = A.welch(stats).collect()
    e = a.var(ddof=1) / 9, b.var(ddof=1) / 14
    t = (a.mean() - b.mean()) / math.sqrt(sum(e))
    df = sum(e) ** 2 / (e[0] ** 2 / 8 + e[1] ** 2 / 13)
    assert (got[0]["t"], got[0]["df"]) == pytest.approx((t, df)) and got[0]["p"] == pytest.approx(A.t_tail(t, df)[0])
    assert [r["p"] for r in got[1:]] == [None, None]


def test_group_quantiles(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), float(rng.randrange(20))) for _ in range(400)] + [("hot", 0, float(i % 97)) for i in range(3000)] + [("one", 1, 5.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, _v int, x double").repartition(5)
    shares = {"p0": 0.0, "_n": 0.33, "median": 0.5, "p100": 1.0}
    got = {(r["k"], r["_v"]): list(r)[2:] for r in O.group_quantiles(df, ["k", "_v"], "x", shares).collect()}
    want = {}
    for k, v, x in rows:
        if x is not None:
            want.setdefault((k, v), []).append(x)
    assert got.keys() == want.keys()
    for k, xs in want.items():
        assert np.allclose(got[k], np.quantile(xs, list(shares.values())))
    assert O.group_quantiles(df.limit(0), ["k"], "x", shares).count() == 0
