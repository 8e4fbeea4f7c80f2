"""Inference, skill, models, explanation, strategy."""

import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ledgerfold.operators import (
    collinear as C, encode as N, explain as X, inference as I, models as M, returns as R, skill as K, strategy as S, windows as W)


@pytest.fixture(scope="module")
def facts():
    rng = np.random.default_rng(11)
    n = 2000
    return pd.DataFrame({"date_id": rng.integers(1, 21, n), "payout": np.where(rng.random(n) < 0.3, rng.random(n) * 30, 0.0), "cost": 5.0,
                         "user_count": rng.integers(1, 9, n), "b": rng.choice(["x", "y"], n), "lineup_percentile": rng.random(n) * 100})


def test_roi_tables_add_up(spark, facts):
    df = spark.createDataFrame(facts)
    t = R.roi_tables(df, {"b": ["b"], "bd": ["b", "date_id"]}).toPandas()
    assert (t.groupby("analysis")["n_entries"].sum() == facts["user_count"].sum()).all()
    whole = R.weighted_roi(df).first()[0]
    assert whole == pytest.approx((facts.payout * facts.user_count).sum() / (facts.cost * facts.user_count).sum())


def test_roi_of_zero_cost_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0)], "payout double, cost double, user_count double")
    assert R.weighted_roi(df).first()[0] is None


def test_bands_nobody_falls_into_stay_with_zero(spark):
    t = R.ratio_of_means(spark.createDataFrame([("a", 2.0, 1.0)], "k string, payout double, cost double"), ["k"])
    got = {r["k"]: (r["n_lineups"], r["roi"]) for r in R.with_all_labels(t, "k", ["a", "b"], ["n_lineups"]).collect()}
    assert got == {"a": (1, 2.0), "b": (0, None)}


def test_nan_becomes_null(spark):
    from ledgerfold.sources.tables import nan_to_null
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, i int"))
    assert df.agg(F.avg("x")).first()[0] == 2.0


def test_comparisons_reach_the_scan(spark, tmp_path):
    from ledgerfold.sources.tables import read_table
    path = str(tmp_path / "t")
    spark.createDataFrame([(float("nan"), 1), (2.0, 2), (None, 3), (5.0, 4)], "x double, i int").write.parquet(path)
    for where, ids in (("x > 1", {2, 4}), ("x >= 2 AND x < 5", {2}), ("x <> 2", {4}), ("i > 1 AND x > 2", {4})):
        df = read_table(spark, path, where=where)
        assert {r["i"] for r in df.collect()} == ids == {r["i"] for r in read_table(spark, path).where(where).collect()}
        pushed = df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("]")[0]
        assert any(k in pushed for k in ("GreaterThan", "EqualTo"))


def test_bootstrap_orders_and_repeats(spark, facts):
    df = spark.createDataFrame(facts)
    a = I.roi_interval(df, ["b"], draws=200).toPandas().sort_values("b")
    b = I.roi_interval(df.repartition(7), ["b"], draws=200).toPandas().sort_values("b")
    assert (a.ci_lower <= a.point_estimate).all() and (a.point_estimate <= a.ci_upper).all()
    assert np.allclose(a[["ci_lower", "ci_upper", "p_value"]], b[["ci_lower", "ci_upper", "p_value"]])
    c = I.bootstrap_ratio(I.event_sums(df, ["b"], "date_id", {"wp": F.col("payout"), "wc": F.col("cost")}), ["b"], "date_id", "wp", "wc",
                          draws=100, with_multiplicity=False).toPandas()
    assert (c["std"] > 0).all()


def test_benjamini_hochberg(spark):
    ps = [0.001, 0.02, 0.03, 0.2, 0.9, 0.04]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    keep = lambda q: {r["i"] for r in I.benjamini_hochberg(df, "p", ["i"], q=q).where("survives_fdr").collect()}
    assert keep(0.1) == {0, 1, 2, 5} and keep(0.01) == {0} and keep(0.0001) == set() and keep(0.01) <= keep(0.1)


def test_thin_period_is_insufficient(spark):
    rows = [(d, 10.0, 1.0, 1.0, "x") for d in range(10) for _ in range(30)] + [(9, 10.0, 1.0, 1.0, "y")] * 5
    df = spark.createDataFrame(rows, "date_id int, payout double, cost double, user_count double, b string")
    v = {r["bucket"]: r for r in I.validate_rules(df, [("b", "x"), ("b", "y")], draws=50).collect()}
    assert v["x"]["holds"] and not v["y"]["holds"] and v["y"]["test_roi"] is None and v["y"]["test_p_value"] == 1.0 and v["y"]["test_n"] == 5


def test_beta_prior(spark):
    prior = lambda rows: tuple(K.beta_prior(spark.createDataFrame(rows, "n_cashes int, n_entries int")).first())
    assert prior([]) == (1.0, 1.0) and prior([(5, 10)] * 3) == (1.0, 1.0)
    rng = np.random.default_rng(0)
    a, b = prior([(int(x), 100) for x in rng.binomial(100, 0.5, 100)])
    assert abs(a / (a + b) - 0.5) < 0.05 and a + b > 10


def test_target_encoding_uses_training_rows_only(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "k string, y double")
    enc = N.fit_target_encoding(train, "k", "y", smoothing=2, min_samples=2)
    got = {r["k"]: r["te"] for r in N.apply_target_encoding(spark.createDataFrame([("a",), ("b",), ("z",)], "k string"), enc, "k", "te").collect()}
    g = 14 / 3
    assert got["a"] == pytest.approx((2 * 2 + 2 * g) / 4) and got["b"] == pytest.approx(g) and got["z"] == pytest.approx(g)


def test_collinearity(spark):
    rng = np.random.default_rng(2)
    a, c = rng.normal(size=100), rng.normal(size=100)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": a, "c": c, "d": 2 * a + 1 + 1e-3 * rng.normal(size=100)}))
    pairs = C.correlated_pairs(df, ["a", "b", "c"], 0.85)
    assert [(r["feature_1"], r["feature_2"]) for r in pairs.collect()] == [("a", "b")]
    assert [r["feature"] for r in C.clusters(pairs).collect()] == ["a", "b"]
    v = {r["feature"]: r["vif"] for r in C.vif(df, ["a", "c", "d"]).collect()}
    assert v["a"] > 10 and v["d"] > 10 and v["c"] < 2
    assert C.vif(df, ["a", "b"]).first()["vif"] == float("inf")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    n = 600
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    p = pd.DataFrame({"id": np.arange(n), "date_id": np.repeat(np.arange(30), 20), "x1": x1, "x2": x2, "y": 50 + 5 * x1 - 3 * x2 + rng.normal(size=n)})
    return spark.createDataFrame(p).cache(), p


def ridge(p, alpha):
    x = p[["x1", "x2"]].to_numpy()
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (p.y - p.y.mean())) / sd
    return np.r_[p.y.mean() - mu @ w, w]


def test_ridge_closed_form(panel):
    df, p = panel
    assert np.allclose(M.fit_ridge(df, ["x1", "x2"], "y", 3.0).first()["coef"], ridge(p, 3.0))


def test_ridge_estimator_matches_closed_form(spark, panel):
    df, p = panel
    alpha = 3.0
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df)
    m = M.estimator("ridge", "y", reg_param=M.ridge_reg_param(df, "y", alpha)).fit(x)
    z = p[["x1", "x2"]].to_numpy()
    z = z - z.mean(0)
    want = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (p.y - p.y.mean()))
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-5)


def test_ridge_walk_forward_equals_refits(panel):
    df, p = panel
    got = M.ridge_walk_forward(df, ["x1", "x2"], "y", min_train=20).toPandas().sort_values("id")
    assert got["fold"].nunique() == 10 and (got["date_id"] >= 20).all()
    for d, g in got.groupby("date_id"):
        c = ridge(p[p.date_id < d], 1.0)
        assert np.allclose(g["prediction"], np.clip(c[0] + g["x1"] * c[1] + g["x2"] * c[2], 0, 100))


def test_bagging_spread(panel):
    df, _ = panel
    out = M.bagged_prediction(df, M.bagged_ridge(df, ["x1", "x2"], "y", members=20), ["x1", "x2"]).toPandas()
    assert (out["pred_std"] > 0).all() and abs(out["pred_mean"] - out["y"]).mean() < 1.5


def test_isotonic_equals_pool_adjacent_violators(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.random(80) * 10)  # ties
    y = x + rng.normal(size=80) * 3
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = M.apply_isotonic(df, M.fit_isotonic(df, "y", "x"), -100, 100).groupBy("x").agg(F.max("calibrated").alias("c")).orderBy("x").toPandas()
    g = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["mean", "size"])
    blocks = []
    for m, w in g.to_numpy():
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (m2, w2, k2), (m1, w1, k1) = blocks.pop(), blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    assert np.allclose(got["c"], [b[0] for b in blocks for _ in range(b[2])])


def test_auc_with_ties_and_one_class(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (0, 0.8)]
    pairs = [(a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z]
    df = spark.createDataFrame(rows, "y int, s double")
    assert M.auc(df, "y", "s").first()[0] == pytest.approx(np.mean(pairs))
    assert M.auc(df.where("y = 1"), "y", "s").first()[0] == 0.5


def test_one_standard_error_pick(spark):
    rows = [(m, f, 0.0, e) for m, errs in {"simple": (1.1, 1.0, 1.2), "complex": (1.0, 0.8, 1.2), "bad": (5.0, 5.0, 5.0)}.items() for f, e in enumerate(errs)]
    cv = spark.createDataFrame(rows, "model string, fold int, y double, prediction double")
    got = M.compare_models(cv, "y", {"simple": 1, "complex": 2, "bad": 0}).where("selected").collect()
    assert [r["model"] for r in got] == ["simple"]


def test_pooling_shrinks_and_ignores_unseen(spark):
    df = spark.createDataFrame([("a", 20.0, 10.0)] * 10 + [("b", 12.0, 10.0)], "t string, y double, p double")
    adj = M.pooling_adjustments(df, "t", "y", "p")
    got = {r["t"]: r["pooled"] for r in M.apply_pooling(spark.createDataFrame([("a", 10.0), ("b", 10.0), ("z", 99.0)], "t string, p double"), adj, "t", "p").collect()}
    assert got["a"] == pytest.approx(15.0) and got["b"] == pytest.approx(10 + 2 / 11) and got["z"] == 99.0


def test_permutation_importance_ranks_features(panel):
    df, _ = panel
    rule = X.column_model(50 + 5 * F.col("x1") - 3 * F.col("x2"))
    got = {r["feature"]: r["importance"] for r in X.permutation_importance(df, rule, ["id"], ["x1", "x2"], "y", repeats=2).collect()}
    assert got["x1"] > got["x2"] > 0


def test_shuffled_copies_keep_the_values(panel):
    df, p = panel
    out = X.shuffled_copies(df, ["id"], ["x1", "x2"], 42, 3).toPandas()
    assert len(out) == 6 * len(p)
    for (f, _), part in out.groupby(["_f", "_rep"]):
        part, other = part.sort_values("id"), "x2" if f == "x1" else "x1"
        assert sorted(part[f]) == sorted(p[f]) and not np.allclose(part[f], p.sort_values("id")[f])
        assert np.allclose(part[other], p.sort_values("id")[other])


def test_shuffled_copies_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, 2.0)], "id int, x double")
    assert [r["x"] for r in X.shuffled_copies(one, ["id"], ["x"], 42, 2).collect()] == [2.0, 2.0]
    assert X.shuffled_copies(one.where("id > 1"), ["id"], ["x"], 42, 2).count() == 0


def test_rule_without_rows_is_reported(spark):
    rows = [(d, 10.0, 1.0, 1.0, "x") for d in range(10) for _ in range(30)]
    df = spark.createDataFrame(rows, "date_id int, payout double, cost double, user_count double, b string")
    v = {r["bucket"]: r for r in I.validate_rules(df, [("b", "x"), ("b", "none")], draws=50).collect()}
    assert v["x"]["holds"] and v["none"]["holds"] is False
    assert (v["none"]["train_n"], v["none"]["test_n"], v["none"]["train_roi"]) == (0, 0, None)


def test_poisson_cuts_reach_the_end_of_the_uniform():
    cuts = I.poisson_cuts()
    assert cuts[-1] > 1 - 2 ** -31 >= cuts[-2]


def test_one_class_resample_counts_half(spark):
    df = spark.createDataFrame([(i, 1, float(i)) for i in range(20)], "id int, y int, s double")
    r = I.row_bootstrap_auc(df, ["id"], "y", "s", draws=10).first()
    assert (r["ci_lower"], r["ci_upper"]) == (0.5, 0.5)


def test_bootstrap_areas_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"id": range(900), "y": rng.integers(0, 2, 900), "s": np.round(rng.normal(size=900), 1)})
    p.loc[:299, "s"] = 0.3  # a third of all rows hold one score
    df = spark.createDataFrame(p).repartition(5)
    seeds = df.select("id", *[c.alias(n) for n, c in I.draw_seeds(42, ["id"]).items()]).toPandas().merge(p, on="id")
    areas = []
    for b in range(20):
        u = ((seeds["_s1"] + seeds["_s2"] * b) % I.DRAW_PRIME / I.DRAW_PRIME).to_numpy()
        w = np.searchsorted(I.poisson_cuts(), u, side="right")
        s, y = np.repeat(seeds["s"].to_numpy(), w), np.repeat(seeds["y"].to_numpy(), w)
        pos, neg = s[y == 1], s[y == 0]
        areas.append(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
    r = I.row_bootstrap_auc(df, ["id"], "y", "s", draws=20).first()
    assert r["std"] == pytest.approx(np.std(areas)) and r["ci_lower"] == pytest.approx(np.quantile(areas, 0.025))


def test_scaled_fills_the_exact_median(spark):
    df = spark.createDataFrame([(1, 1.0, "b", 5.0), (2, 2.0, "a", 5.0), (3, 4.0, None, 5.0), (4, 9.0, "b", 5.0), (5, None, "c", 5.0)], "id int, x double, g string, k double")
    got = M.scaled(df, ["x", "k"], ["g"]).orderBy("id").toPandas()
    want = np.array([1, 2, 4, 9, 3.0])
    assert np.allclose(got["x_z"], (want - want.mean()) / want.std()) and list(got["k_z"]) == [0.0] * 5
    assert [None if pd.isna(v) else int(v) for v in got["g_slot"]] == [1, 0, None, 1, 2]


def test_order_is_one_without_a_testable_series(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "e string, d int, v double")
    r = W.min_stationary_order(df, ["e"], "d", "v", [0.0, 0.5], threshold=0.1).first()
    assert (r["min_d"], r["n_orders_tested"]) == (1.0, 0)


def test_product_interacts_more_than_sum(panel):
    df, _ = panel
    add = X.interactions(df, X.column_model(F.col("x1") + F.col("x2")), ["x1", "x2"], grid=5).first()["h"]
    mul = X.interactions(df, X.column_model(F.col("x1") * F.col("x2")), ["x1", "x2"], grid=5).first()["h"]
    assert mul > 0.9 > add  # one-way grids stop at the 5th and 95th percentile, two-way ones do not


def test_interactions_equal_grids_by_hand(spark):
    p = pd.DataFrame({"x": np.arange(40) % 7 / 2, "y": np.arange(40) % 11 * 1.5, "z": [2.0] * 40})
    model = lambda x, y, z: x * y + z * x - y
    got = {(r["feature1"], r["feature2"]): r["h"] for r in X.interactions(
        spark.createDataFrame(p), X.column_model(F.expr("x * y + z * x - y")), ["x", "y", "z"], grid=6).collect()}

    def spread(*names):
        lo, hi = (0.05, 0.95) if len(names) == 1 else (0, 1)
        axes = [np.linspace(p[n].quantile(lo), p[n].quantile(hi), 6) for n in names]
        return np.var([model(**{**{c: p[c] for c in p}, **dict(zip(names, v))}).mean() for v in itertools.product(*axes)])

    for a, b in itertools.combinations("xyz", 2):
        both = spread(a, b)
        want = max(0.0, (both - spread(a) - spread(b)) / both) if both else 0.0
        assert got[a, b] == pytest.approx(want, abs=1e-9)


def test_shuffling_within_folds_keeps_each_folds_values(spark):
    rows = [(i, i % 3 if i % 5 else 7, float(i), float(i % 4)) for i in range(90)] + [(100, 9, 1.0, 1.0)]  # fold 9 has one row
    df = spark.createDataFrame(rows, "id long, fold int, x double, y double")
    out = X.shuffled_copies(df, ["id"], ["x"], 42, 3, "fold").toPandas()
    p = df.toPandas()
    assert len(out) == 3 * len(p)
    for (fold, _), part in out.groupby(["fold", "_rep"]):
        own = p[p.fold == fold]
        assert sorted(part.x) == sorted(own.x)
        assert len(own) == 1 or (part.sort_values("id").x.to_numpy() != own.sort_values("id").x.to_numpy()).all()
    imp = X.permutation_importance(df.withColumn("t", F.col("x")), X.column_model(F.col("x")), ["id"], ["x"], "t", repeats=2, fold="fold").toPandas().set_index("fold").importance
    assert imp[9] == 0 and (imp.drop(9) > 0).all() and len(imp) == 5


def test_equal_rows_meet_a_grid_once(spark):
    rows = [(float(i % 2), float(i % 3), float(i % 5)) for i in range(300)] + [(None, 1.0, 2.0), (1.0, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    p = df.toPandas()
    seen = []

    def model(d):
        seen.append(d)
        return d.withColumn("prediction", F.expr("x * y + z"))

    got = {(r["v1"], r["v2"]): r["pd"] for r in X.partial_dependence_2d(df, model, "x", "y", grid=5).collect()}
    assert seen.pop().count() == 25 * 6  # the other column holds five values and null
    assert len(got) == 25 and all(v == pytest.approx(a * b + p.z.mean()) for (a, b), v in got.items())
    line = {r["grid_value"]: r["pd"] for r in X.partial_dependence(df, model, "x", grid=4).collect()}
    assert seen.pop().count() == 4 * (15 + 2 - 1)  # of the added rows one is like others without x
    both = p.dropna(subset=["y", "z"])
    assert len(line) == 4 and all(v == pytest.approx((a * both.y + both.z).mean()) for a, v in line.items())
    X.interactions(df, model, ["x", "y", "z"], grid=5)
    assert seen.pop().count() == (3 * 5 + 3 * 25) * (30 + 2)
    same = X.partial_dependence_2d(df.withColumn("x", F.lit(1.0)), model, "x", "y", grid=5)
    assert same.count() == 5  # a constant feature has one point
    assert X.partial_dependence_2d(df.where("z > 9"), model, "x", "y").count() == 0


def test_copies_are_rotations_over_blocks_and_multiplied_last(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    rows = [(i, i % 2 if i > 4 else 5, float(i) if i % 6 else None, f"n{i}") for i in range(61)]
    df = spark.createDataFrame(rows, "id long, fold int, x double, name string")
    for fold in (None, "fold"):
        out = X.shuffled_copies(df, ["id"], ["x", "name"], 42, 5, fold)
        got = out.toPandas()
        assert out.columns == [*df.columns, "_f", "_rep"] and len(got) == 10 * len(rows)
        for at, part in got.groupby(["_f", "_rep", "fold"] if fold else ["_f", "_rep"]):
            own = [r for r in rows if not fold or r[1] == at[2]]
            seed = 42 + at[2] if fold else 42
            own.sort(key=lambda r: hashlib.md5(f"{seed}|{r[0]}".encode()).hexdigest())
            k, n = (2 if at[0] == "x" else 3), len(own)
            part = part.astype(object).where(part.notna(), None).set_index("id")
            values, other = [r[k] for r in own], 5 - k
            new = [part.loc[r[0]][at[0]] for r in own]
            assert any(new == values[s:] + values[:s] for s in range(1, n))
            assert [part.loc[r[0]]["name" if k == 2 else "x"] for r in own] == [r[other] for r in own]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode" in plan and plan.index("Generate") < plan.index("Join")


def test_deflated_sharpe(spark):
    df = spark.createDataFrame([(2.0, 1), (2.0, 10), (2.0, 1000), (-1.0, 1)], "s double, n int")
    d = [r[0] for r in df.select(S.deflated_sharpe("s", "n")).collect()]
    assert d[0] == 1.0 and d[3] == 0.0 and 0 <= d[2] < d[1] <= 1


def test_sharpe_of_constant_and_single(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("b", 0.5)], "k string, r double")
    assert {r[1] for r in df.groupBy("k").agg(S.sharpe("r")).collect()} == {0.0}


def test_metrics_pipeline_with_unseen_category(spark):
    train = spark.createDataFrame([(1.0, "a", 1.0), (2.0, "b", 2.0), (None, "a", 3.0)], "x double, c string, y double")
    m = Pipeline(stages=M.preprocessing(["x"], ["c"])).fit(train)
    assert m.transform(spark.createDataFrame([(None, "z")], "x double, c string")).count() == 1


def test_missing_numbers_take_the_exact_lower_median(spark):
    rows = [(1.0, 4, float("nan")), (None, 9, float("inf")), (float("nan"), None, float("inf")), (5.0, 1, 0.5), (2.0, 7, None), (7.0, 2, 1.0)]
    df = spark.createDataFrame(rows, "x double, k int, `odd name` double")
    made = M.MedianImputer(["x", "k", "odd name"], ["a", "b", "c"]).fit(df).transform(df)
    assert made.schema["b"].dataType == df.schema["k"].dataType
    got = [(r["a"], r["b"], r["c"]) for r in made.collect()]
    inf = float("inf")
    assert got == [(1.0, 4, 1.0), (2.0, 9, inf), (2.0, 4, inf), (5.0, 1, 0.5), (2.0, 7, 1.0), (7.0, 2, 1.0)]
    with pytest.raises(ValueError):
        M.MedianImputer(["x"], ["a"]).fit(df.where("x > 9"))
    # no sketch of all values goes to the driver
    assert not any("Imputer" == type(s).__name__ for s in M.preprocessing(["x"]))


def test_pooling_does_not_gather_a_type_in_one_task(spark):
    df = spark.createDataFrame([("a", 5.0, 4.0), ("a", 7.0, 4.0), ("b", 1.0, 2.0), (None, 1.0, 2.0)], "ct string, y double, p double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from ledgerfold.operators import models as M
        out = M.apply_pooling(df, M.pooling_adjustments(df, "ct", "y", "p", strength=0.0), "ct", "p")
        assert sorted((r["ct"] or "", r["pooled"]) for r in out.collect()) == [("", 2.0), ("a", 6.0), ("a", 6.0), ("b", 1.0)]
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_contest_means_with_one_cost_a_contest_need_no_contest_partials(spark):
    rows = [("a" if i % 3 else "b", i % 7, None if i % 5 == 0 else float(i), float(i % 7)) for i in range(60)]
    d = spark.createDataFrame(rows, "g string, contest_id long, payout double, fee double")
    two, one = (R.contest_mean_roi(d, ["g"], cost="fee", extra=[F.sum("payout").alias("paid")], same_cost=s) for s in (False, True))
    got, want = ({r["g"]: tuple(r)[1:] for r in x.collect()} for x in (one, two))
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert one._jdf.queryExecution().executedPlan().toString().count("contest_id") < two._jdf.queryExecution().executedPlan().toString().count("contest_id")
