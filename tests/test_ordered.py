"""Distributed ordered operators, with a group that holds a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import folds as V, ordered as O, windows as W


@pytest.fixture(scope="module")
def hot():
    rng = np.random.default_rng(1)
    n = 3000
    g = np.where(np.arange(n) % 3 == 0, "hot", [f"g{i % 40}" for i in range(n)])
    return pd.DataFrame({"g": g, "i": rng.permutation(n), "x": np.round(rng.normal(size=n), 1), "d": rng.integers(0, 50, n)})


def test_hot_group_is_split(spark, hot):
    parts = O.range_parts(spark.createDataFrame(hot), ["g"], ["i"])
    held = parts.where("g = 'hot'").select(O.PART).distinct().count()
    assert held > 1
    largest = parts.groupBy(O.PART).count().agg(F.max("count")).first()[0]
    assert largest < 0.5 * len(hot)


def test_running_equals_pandas(spark, hot):
    got = O.running(spark.createDataFrame(hot), ["g"], ["i"], number="rn", sums={"s": "x"}, maxima={"m": "x"}).toPandas().sort_values("i")
    p = hot.sort_values("i").copy()
    p["rn"] = p.groupby("g").cumcount() + 1
    p["s"], p["m"] = p.groupby("g")["x"].cumsum(), p.groupby("g")["x"].cummax()
    assert (got["rn"].to_numpy() == p["rn"].to_numpy()).all()
    assert np.allclose(got["s"], p["s"]) and (got["m"].to_numpy() == p["m"].to_numpy()).all()


def test_running_descending_and_global(spark, hot):
    got = O.running(spark.createDataFrame(hot), [], ["-x", "i"], number="rn").toPandas().sort_values("rn")
    want = hot.sort_values(["x", "i"], ascending=[False, True])
    assert (got["i"].to_numpy() == want["i"].to_numpy()).all()


def test_percentiles_equal_pandas(spark, hot):
    got = O.percentiles(spark.createDataFrame(hot), ["g"], "x", {"a": 0.0, "b": 0.37, "c": 0.9}).toPandas().set_index("g").sort_index()
    want = hot.groupby("g")["x"].quantile([0.0, 0.37, 0.9]).unstack()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_percentiles_ignore_null_and_single_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, x double")
    assert [tuple(r) for r in O.percentiles(df, ["g"], "x", {"m": 0.5}).collect()] == [("a", 1.0)]


@pytest.mark.parametrize("method", ["min", "max", "average", "dense", "pct"])
def test_ranks_equal_pandas(spark, hot, method):
    got = O.ranks(spark.createDataFrame(hot), ["g"], "x", name="r", method=method).toPandas().sort_values("i")["r"].to_numpy(float)
    p = hot.sort_values("i")
    want = p.groupby("g")["x"].rank(pct=True) if method == "pct" else p.groupby("g")["x"].rank(method=method)
    assert np.allclose(got, want)


def test_attach_row_rejects_a_second_row(spark):
    with pytest.raises(Exception):
        O.attach_row(spark.range(3), spark.range(2).withColumnRenamed("id", "x")).collect()


def test_row_lags_equal_pandas(spark, hot):
    got = W.row_lags(spark.createDataFrame(hot), ["g"], ["i"], "x", [1, 3]).toPandas().sort_values("i")
    p = hot.sort_values("i")
    for k in (1, 3):
        assert np.allclose(got[f"x_lag{k}"], p.groupby("g")["x"].shift(k), equal_nan=True)


def test_row_expanding_mean(spark, hot):
    got = W.row_expanding_mean(spark.createDataFrame(hot), ["g"], ["i"], "x").toPandas().sort_values("i")
    p = hot.sort_values("i")
    want = p.groupby("g")["x"].transform(lambda s: s.shift(1).expanding().mean())
    assert np.allclose(got["x_exp_mean"], want, equal_nan=True)


def test_equity_curve(spark, hot):
    got = W.equity_curve(spark.createDataFrame(hot), ["g"], ["i"], "x").toPandas().sort_values("i")
    p = hot.sort_values("i")
    eq = p.groupby("g")["x"].cumsum()
    dd = eq.groupby(p["g"]).cummax() - eq
    assert np.allclose(got["equity"], eq) and np.allclose(got["drawdown"], dd)


def test_rolling_excludes_current_row_and_future(spark, hot):
    w = W.timeline(["g"], "d")

    def features(pdf):
        panel = W.collapse(spark.createDataFrame(pdf), ["g"], "d", {"x": "avg"})
        return W.expanding(W.rolling(panel, ["x"], [3], w, aggs=("mean", "std"), min_periods=2), ["x"], w).toPandas().sort_values(["g", "d"])

    a = features(hot)
    later = hot.copy()
    later.loc[later["d"] > 25, "x"] += 100
    b = features(later)
    cols = ["x_roll3_mean", "x_roll3_std", "x_exp_mean"]
    early = a["d"] <= 26  # features of date 26 use dates up to 25
    assert np.allclose(a.loc[early, cols], b.loc[early.to_numpy(), cols], equal_nan=True)
    p = hot.groupby(["g", "d"], as_index=False)["x"].mean().sort_values(["g", "d"])
    want = p.groupby("g")["x"].transform(lambda s: s.shift(1).rolling(3, min_periods=2).mean())
    assert np.allclose(a["x_roll3_mean"], want, equal_nan=True)


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 7, 0)], "k string, id int, v int")
    assert sorted(map(tuple, W.keep_first(df, ["k"], ["-v", "id"]).select("k", "id").collect())) == [("a", 2), ("b", 7)]


def test_frac_diff_equals_direct_sum(spark):
    x = np.random.default_rng(3).normal(size=40).cumsum()
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, d int, x double")
    got = W.frac_diff(df, "x", W.timeline(["g"], "d"), 0.4, 0.01).toPandas().sort_values("d")["x_fd"].to_numpy(float)
    w = W.ffd_weights(0.4, 0.01)
    m = len(w)
    want = [np.nan if i < m - 1 else sum(w[k] * x[i - k] for k in range(m)) for i in range(40)]
    assert abs(w[-1]) < 0.01 <= abs(w[-2]) and np.allclose(got, want, equal_nan=True)


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    s = rng.integers(0, 60, 200)
    e = s + rng.integers(0, 15, 200)
    df = spark.createDataFrame(list(zip(range(200), map(int, s), map(int, e))), "id int, s int, e int")
    got = V.overlaps(df, "s", "e").toPandas().sort_values("id")["n_overlaps"].to_numpy()
    assert (got == [int(((s <= e[i]) & (e >= s[i])).sum()) for i in range(200)]).all()
    u = V.uniqueness(df, "s", "e").toPandas()
    assert u["weight"].sum() == pytest.approx(200)


def test_walk_forward_folds(spark):
    df = spark.createDataFrame([(d, p) for d in range(30) for p in range(10)], "date_id int, pid int")
    f = V.walk_forward(df, "date_id", 20).orderBy("fold").collect()
    assert len(f) == 10 and [r["test_event"] for r in f] == list(range(20, 30)) and [r["train_last_no"] for r in f] == list(range(20, 30))
    assert V.walk_forward(df.where("date_id < 2"), "date_id", 20).count() == 0
    roles = V.walk_forward_roles(df, "date_id", 20).toPandas()
    assert roles["fold"].nunique() == 10 and (roles["role"] == "test").sum() == 10
    for k, g in roles.groupby("fold"):
        test = g.loc[g["role"] == "test", "date_id"].item()
        assert test == 20 + k and set(g.loc[g["role"] == "train", "date_id"]) == set(range(test))


def test_holdout(spark):
    df = spark.createDataFrame([(d,) for d in range(12)], "date_id int")
    assert V.holdout(df, "date_id", 10).where("is_holdout").count() == 10
    with pytest.raises(ValueError):
        V.holdout(df, "date_id", 12)


def test_row_fold_bounds():
    for f, end, a, b in V.purged_bounds(103, 5, 0.02, 0.01):
        assert 0 < end <= a - 3 and b - a == 20
    assert [b[0] for b in V.purged_bounds(100, 5)] == [1, 2, 3, 4]
    r = V.rolling_bounds(100, 4, gap=2, expanding=False)
    assert all(x[3] - x[2] == 2 and x[2] - x[1] == 20 and x[4] <= 100 for x in r)
    assert V.ratio_bounds(100, 0.2, 5) == [(0, 75, 80, 100)]
