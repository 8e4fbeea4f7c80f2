"""Folds, collinearity, models, explanation and strategies (V*, J11, J16, C06-C12, M*, I*, T*)."""

from __future__ import annotations

import math
import re
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ledgerfold import presets as P
from ledgerfold.operators import collinear as C, explain as X, folds as V, inference as I, models as M, strategy as S, trees as T
from ledgerfold.plans.features import rounded
from ledgerfold.plans.registry import query, r6
from ledgerfold.plans.returns import bootstrap_sql
from ledgerfold.session import materialize

EV = """
, ev AS (SELECT date_id, row_number() OVER (ORDER BY date_id) AS no, count(*) OVER () AS total FROM (SELECT DISTINCT date_id FROM players))
"""


@query("V01_walk_forward_folds", EV + """
, pe AS (SELECT date_id, count(*) AS n FROM players GROUP BY 1)
SELECT (no - 21)::INT AS fold, date_id AS test_event, (sum(n) OVER (ORDER BY no))::BIGINT - n AS n_train, n AS n_test FROM ev JOIN pe USING (date_id) QUALIFY no > 20""")
def _(t):
    return V.fold_events(t.players, "date_id", P.MIN_TRAIN_EVENTS)


@query("J16_fold_join", EV + """
SELECT (f.no - 21)::INT AS fold, count(*) FILTER (e.no < f.no) AS n_train, count(*) FILTER (e.no = f.no) AS n_test
FROM players p JOIN ev e USING (date_id) JOIN ev f ON f.no > 20 AND e.no <= f.no GROUP BY 1""")
def _(t):
    per = t.players.groupBy("date_id").agg(F.count(F.lit(1)).alias("c"))  # reduce before meeting the folds
    j = per.join(V.walk_forward_roles(t.players, "date_id", P.MIN_TRAIN_EVENTS), "date_id")
    rows = lambda role: F.sum(F.when(F.col("role") == role, F.col("c")).otherwise(0))
    return j.groupBy("fold").agg(rows("train").alias("n_train"), rows("test").alias("n_test"))


@query("V02_holdout", EV + """
SELECT no > total - 10 AS is_holdout, count(*) AS n, count(DISTINCT date_id) AS n_events, min(date_id) AS first_date FROM players JOIN ev USING (date_id) GROUP BY 1""")
def _(t):
    return V.holdout(t.players, "date_id", 10).groupBy("is_holdout").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("date_id").alias("n_events"), F.min("date_id").alias("first_date"))


ROWS = """
, nr AS (SELECT *, row_number() OVER (ORDER BY date_id, contest_id, player_id) - 1 AS row_no, count(*) OVER () AS n FROM players)
"""


def numbered(t):
    return V.number_rows(t.players.select("date_id", "contest_id", "player_id", "actual_points"), ["date_id", "contest_id", "player_id"])


def fold_summary(t, bounds_of):
    d = numbered(t)
    r = V.fold_roles(d, bounds_of(d.count()))
    return r.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
                                         r6(F.avg("actual_points")).alias("mean_y"))


_SUM = "SELECT fold, role, count(*) AS n, min(row_no) AS first_row, max(row_no) AS last_row, round(avg(actual_points), 6) AS mean_y FROM l GROUP BY 1, 2"


@query("V03_purged_folds", ROWS + """
, f AS (SELECT unnest(range(5))::INT AS fold), b AS (SELECT fold, n - (5 - fold)*(n//5) AS ts, n//5 AS sz, floor(n*0.01::DOUBLE)::BIGINT + floor(n*0.02::DOUBLE)::BIGINT AS gap FROM f, (SELECT max(n) AS n FROM nr)),
l AS (SELECT fold, row_no, actual_points, CASE WHEN row_no < ts - gap THEN 'train' WHEN row_no >= ts AND row_no < ts + sz THEN 'test' END AS role
      FROM nr, b WHERE ts - gap > 0 AND (row_no < ts - gap OR (row_no >= ts AND row_no < ts + sz)))
""" + _SUM)
def _(t):
    return fold_summary(t, lambda n: V.purged_bounds(n, 5, 0.01, 0.02))


@query("V04_rolling_origin_folds", ROWS + """
, f AS (SELECT unnest(range(4))::INT AS fold), b AS (SELECT fold, n//5 + fold*greatest(1, (n - n//5 - n//5 - 100)//4) AS te, n//5 AS sz, n FROM f, (SELECT max(n) AS n FROM nr)),
l AS (SELECT fold, row_no, actual_points, CASE WHEN row_no < te THEN 'train' ELSE 'test' END AS role FROM nr, b
      WHERE (row_no >= greatest(0, te - sz) AND row_no < te) OR (row_no >= te + 100 AND row_no < least(te + 100 + sz, b.n)))
""" + _SUM)
def _(t):
    return fold_summary(t, lambda n: V.rolling_bounds(n, 4, gap=100, expanding=False))


@query("V05_ratio_split", ROWS + """
, l AS (SELECT 0 AS fold, row_no, actual_points, CASE WHEN row_no < n - floor(n*0.2::DOUBLE) - 50 THEN 'train' ELSE 'test' END AS role FROM nr
        WHERE row_no < n - floor(n*0.2::DOUBLE) - 50 OR row_no >= n - floor(n*0.2::DOUBLE))
""" + _SUM)
def _(t):
    return fold_summary(t, lambda n: V.ratio_bounds(n, 0.2, 50))


def intervals(t):
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ends"))
    o = t.orders.select("o_orderkey", F.col("o_orderdate").alias("starts")).join(e, "o_orderkey")
    return o.withColumn("ends", F.greatest("ends", "starts"))


SPANS = """
, sp AS (SELECT o_orderkey, o_orderdate AS starts, greatest(o_orderdate, m) AS ends FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
ds AS (SELECT starts AS t, count(*) AS c FROM sp GROUP BY 1), de AS (SELECT ends AS t, count(*) AS c FROM sp GROUP BY 1),
ov AS (SELECT o_orderkey, starts, ends, (SELECT sum(c) FROM ds WHERE ds.t <= sp.ends)::BIGINT - coalesce((SELECT sum(c) FROM de WHERE de.t < sp.starts), 0)::BIGINT AS n_overlaps FROM sp)
"""


@query("J11_interval_overlaps", SPANS + "SELECT o_orderkey, n_overlaps FROM ov")
def _(t):
    return V.overlaps(intervals(t), "starts", "ends").select("o_orderkey", "n_overlaps")


@query("C07_sample_uniqueness", SPANS + """
SELECT o_orderkey, round(1/greatest(n_overlaps, 1), 9) AS uniqueness, round((1/greatest(n_overlaps, 1))*count(*) OVER ()/sum(1/greatest(n_overlaps, 1)) OVER (), 6) AS weight FROM ov""")
def _(t):
    u = V.uniqueness(intervals(t), "starts", "ends")
    return u.select("o_orderkey", r6("uniqueness", 9).alias("uniqueness"), r6("weight").alias("weight"))


@query("C08_embargo_ends", """
, s AS (SELECT (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) AS d FROM orders)
SELECT o_orderkey, ((epoch_us(o_orderdate) + floor(d*0.01::DOUBLE)::BIGINT)//1000000)::BIGINT AS embargo_epoch FROM orders, s""")
def _(t):
    return V.embargo_ends(t.orders, "o_orderdate", 0.01).select("o_orderkey", F.unix_timestamp("embargo_end").alias("embargo_epoch"))


# ---- collinearity -----------------------------------------------------------
NUM = ["salary", "ownership", "close_prob", "open_prob", "p_size"]


@query("C10_correlated_pairs", """
, c AS (SELECT """ + ", ".join(f"corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) AS \"{a}|{b}\""
                              for i, a in enumerate(NUM) for b in NUM[i + 1:]) + """ FROM players),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME pair VALUE r)
SELECT split_part(pair, '|', 1) AS feature_1, split_part(pair, '|', 2) AS feature_2, round(r, 4) AS r FROM u WHERE abs(r) > 0.01""")
def _(t):
    return C.correlated_pairs(t.players, NUM, 0.01).select("feature_1", "feature_2", r6("r", 4).alias("r"))


@query("C11_variance_inflation", """
, p AS (SELECT close_prob AS a, open_prob AS b FROM players WHERE open_prob IS NOT NULL), r AS (SELECT corr(a, b) AS r FROM p)
SELECT 'close_prob' AS feature, round(1/(1-r*r), 4) AS vif FROM r UNION ALL SELECT 'open_prob', round(1/(1-r*r), 4) FROM r""")
def _(t):
    return C.vif(t.players, ["close_prob", "open_prob"]).select("feature", r6("vif", 4).alias("vif"))


@query("C12_feature_clusters", """
, r AS (SELECT abs(corr(close_prob, open_prob)) >= 0.85 AS hit FROM players WHERE open_prob IS NOT NULL)
SELECT 'close_prob' AS cluster, unnest(['close_prob', 'open_prob']) AS feature FROM r WHERE hit""")
def _(t):
    return C.clusters(C.correlated_pairs(t.players, NUM, 0.85))


@query("C13_feature_registry", """
SELECT DISTINCT unnest(['salary', 'close_prob', 'p_size']) AS feature, CASE unnest(['salary', 'close_prob', 'p_size']) WHEN 'close_prob' THEN 'price' WHEN 'salary' THEN 'slate' ELSE 'entity' END AS family,
       (SELECT count(*) FROM players) AS n_values""")
def _(t):
    from ledgerfold.operators.encode import assert_no_leakage
    reg = {"salary": "slate", "close_prob": "price", "p_size": "entity"}
    assert_no_leakage(reg)
    one = t.players.agg(*[F.count(c).alias(c) for c in reg])
    arr = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(v).alias("family"), F.col(k).alias("n_values")) for k, v in reg.items()])
    return one.select(F.explode(arr).alias("x")).select("x.*")


@query("C06_preprocessing", """
, md AS (SELECT median(open_prob) AS mo, median(salary) AS ms FROM players),
fl AS (SELECT player_id, contest_id, weight_class, coalesce(open_prob, mo) AS o, coalesce(salary, ms) AS s FROM players, md),
st AS (SELECT avg(o) AS ao, stddev_pop(o) AS so, avg(s) AS sa, stddev_pop(s) AS ss FROM fl)
SELECT player_id, contest_id, round((o - ao)/so, 6) AS open_prob_z, round((s - sa)/ss, 6) AS salary_z,
       (SELECT count(DISTINCT weight_class) FROM players WHERE weight_class < fl.weight_class) AS weight_class_slot FROM fl, st""")
def _(t):
    d = t.players.select("player_id", "contest_id", "open_prob", "salary", "weight_class")
    z = M.scaled(d, ["open_prob", "salary"], ["weight_class"])
    return z.select("player_id", "contest_id", r6("open_prob_z").alias("open_prob_z"), r6("salary_z").alias("salary_z"), "weight_class_slot")


# ---- linear models ------------------------------------------------------------
X2 = ["close_prob", "ownership"]
# Ridge on two standardised features in closed form: with correlation r between
# the features and r1, r2 to the target, w = n*sy*[(n+a) r1 - n r r2, ...]/det.
RIDGE = """
, sm AS (SELECT {by} count(*)::DOUBLE AS n, avg(close_prob) AS m1, avg(ownership) AS m2, avg(actual_points) AS my, stddev_pop(close_prob) AS s1, stddev_pop(ownership) AS s2,
         stddev_pop(actual_points) AS sy, corr(close_prob, ownership) AS r, corr(close_prob, actual_points) AS r1, corr(ownership, actual_points) AS r2 FROM {src}),
cf AS (SELECT *, n*sy*((n+{a})*r1 - n*r*r2)/((n+{a})*(n+{a}) - n*r*n*r)/s1 AS w1, n*sy*((n+{a})*r2 - n*r*r1)/((n+{a})*(n+{a}) - n*r*n*r)/s2 AS w2 FROM sm)
"""


@query("M01_ridge", RIDGE.format(by="", src="players", a="5.0::DOUBLE") + """
SELECT round(w1, 6) AS w_close_prob, round(w2, 6) AS w_ownership, round(my - w1*m1 - w2*m2, 6) AS intercept, n::BIGINT AS n_rows FROM cf""")
def _(t):
    f = M.fit_ridge(t.players, X2, "actual_points", 5.0)
    return f.select(r6(F.col("coef")[1]).alias("w_close_prob"), r6(F.col("coef")[2]).alias("w_ownership"), r6(F.col("coef")[0]).alias("intercept"), "n_rows")


@query("M01_ridge_estimator")
def _(t):
    # the joined rows once, every step of the fit reads them again
    d = materialize(t.players.select("player_id", "contest_id", "close_prob", "ownership", "actual_points"), "players")
    reg = M.ridge_reg_param(d, "actual_points", 5.0)
    m = Pipeline(stages=M.preprocessing(X2) + [M.estimator("ridge", "actual_points", reg_param=reg)]).fit(d)
    p = M.clipped(m.transform(d))
    return M.regression_metrics(p, "actual_points", "prediction").select(*[r6(c, 4).alias(c) for c in ("mae", "rmse", "r2")], "n")


def tree_folds(t, **learners):
    """Walk-forward predictions of tree models from the 21st event on."""
    d = t.players.select("date_id", "close_prob", "ownership", "salary", "weight_class", "actual_points")
    return T.walk_forward(d, learners, "actual_points", "date_id", ["close_prob", "ownership", "salary"], ["weight_class"], min_train=P.MIN_TRAIN_EVENTS)


def fold_report(cv, keys=("fold",)):
    m = M.regression_metrics(cv, "actual_points", "prediction", list(keys))
    return m.select(*keys, *[r6(c, 4).alias(c) for c in ("mae", "rmse", "r2", "mean_pred", "calibration_ratio")],
                    r6("mean_actual", 9).alias("mean_actual"), "n")


RIDGE_FOLDS = EV + """
, tr AS (SELECT f.no AS fno, f.date_id AS test, p.* EXCLUDE (date_id) FROM ev f JOIN ev e ON e.no < f.no JOIN players p ON p.date_id = e.date_id WHERE f.no > 20)
""" + RIDGE.format(by="test,", src="tr GROUP BY test", a="1.0::DOUBLE")


@query("M02_ridge_walk_forward", RIDGE_FOLDS + """
, pr AS (SELECT test, p.actual_points AS y, least(greatest(my - w1*m1 - w2*m2 + w1*close_prob + w2*ownership, 0), 100) AS yh FROM players p JOIN cf ON p.date_id = test)
SELECT (no - 21)::INT AS fold, round(avg(abs(yh-y)), 4) AS mae, round(sqrt(avg((yh-y)*(yh-y))), 4) AS rmse, round(1 - sum((yh-y)*(yh-y))/(var_pop(y)*count(*)), 4) AS r2,
       round(avg(yh), 4) AS mean_pred, round(avg(y), 9) AS mean_actual, round(avg(yh)/avg(y), 4) AS calibration_ratio, count(*) AS n FROM pr JOIN ev ON date_id = test GROUP BY no""")
def ridge_walk_forward(t):
    return fold_report(M.ridge_walk_forward(t.players, X2, "actual_points", min_train=P.MIN_TRAIN_EVENTS))


@query("M02_forest_walk_forward")
def _(t):
    return fold_report(tree_folds(t, forest=T.FOREST))


@query("M02_boosted_walk_forward")
def _(t):
    return fold_report(tree_folds(t, boosted=T.BOOSTED))


@query("M03_ensemble")
def _(t):
    d = t.players
    pre = M.preprocessing(["close_prob", "ownership", "salary"])
    make = lambda k, **kw: Pipeline(stages=pre + [M.estimator(k, "actual_points", **kw)]).fit(d)
    e = M.ensemble(d, {"ridge": make("ridge", reg_param=0.001), "forest": make("forest")})
    return e.select("player_id", "contest_id", *[r6(c, 4).alias(c) for c in ("pred_ridge", "pred_forest", "prediction")])


@query("M04_compare_models")
def _(t):
    trees = tree_folds(t, forest=T.FOREST, boosted=T.BOOSTED).select("model", "fold", "actual_points", "prediction")
    linear = M.ridge_walk_forward(t.players, X2, "actual_points", min_train=P.MIN_TRAIN_EVENTS).select(F.lit("ridge").alias("model"), "fold", "actual_points", "prediction")
    m = M.compare_models(trees.unionByName(linear), "actual_points", {"ridge": 1, "forest": 2, "boosted": 3})
    return m.select("model", r6("cv_mean", 4).alias("cv_mean"), r6("cv_std", 4).alias("cv_std"), "n_folds", "selected")


@query("M05_random_search")
def _(t):
    params = M.sample_params({"trees": [50, 100, 200], "depth": [5, 10, 20, None], "split": [2, 5, 10], "leaf": [1, 2, 4]}, 20)
    d = t.players.select("date_id", "contest_id", "player_id", "close_prob", "ownership", "actual_points")
    s = M.random_search(d, ["date_id", "contest_id", "player_id"], "forest", "actual_points", params, ["close_prob", "ownership"], k=5)
    return s.select("trial", "params", r6("cv_rmse", 4).alias("cv_rmse"))


FORMULA = "60 * close_prob + 0.5D * ownership + close_prob * ownership / 10"
FSQL = "(60*close_prob + 0.5::DOUBLE*ownership + close_prob*ownership/10)"
PRED = f", pr AS (SELECT *, least(greatest({FSQL}, 0), 100) AS prediction FROM players)"


def predicted(t):
    return M.clipped(t.players.withColumn("prediction", F.expr(FORMULA)))


@query("M06_regression_metrics", PRED + """
SELECT brand, round(avg(abs(prediction-actual_points)), 6) AS mae, round(sqrt(avg(pow(prediction-actual_points, 2))), 6) AS rmse,
 round(1 - sum(pow(prediction-actual_points, 2))/(var_pop(actual_points)*count(*)), 6) AS r2, round(100*avg(abs((prediction-actual_points)/(actual_points + 1e-8))), 4) AS mape, count(*) AS n FROM pr GROUP BY 1""")
def _(t):
    m = M.regression_metrics(predicted(t), "actual_points", "prediction", ["brand"])
    return m.select("brand", *[r6(c).alias(c) for c in ("mae", "rmse", "r2")], r6("mape", 4).alias("mape"), "n")


LAB = ", lb AS (SELECT (actual_points > 50)::INT AS y, close_prob AS p FROM players)"
AUC_SQL = """, rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1)/2 AS r FROM lb),
au AS (SELECT (sum(r) FILTER (y = 1) - sum(y)*(sum(y)+1)/2)/(sum(y)*(count(*)-sum(y))) AS auc FROM rk)"""


@query("M06_binary_metrics", LAB + AUC_SQL + """
SELECT round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round(sum((p >= 0.5)::INT*y)/sum((p >= 0.5)::INT), 6) AS "precision", round(sum((p >= 0.5)::INT*y)/sum(y), 6) AS recall,
 round(2*sum((p >= 0.5)::INT*y)/(sum((p >= 0.5)::INT) + sum(y)), 6) AS f1, round(avg(-(y*ln(least(greatest(p, 1e-15), 1-1e-15)) + (1-y)*ln(1-least(greatest(p, 1e-15), 1-1e-15)))), 6) AS log_loss,
 round(any_value(auc), 6) AS auc, count(*) AS n FROM lb, au""")
def _(t):
    d = t.players.select((F.col("actual_points") > 50).cast("int").alias("y"), F.col("close_prob").alias("p"))
    m = M.binary_metrics(d, "y", "p")
    return m.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "log_loss", "auc")], "n")


@query("M06_label_auc", """
, j AS (SELECT lang, quality AS y, n_chars AS p FROM labels JOIN documents USING (doc_id)),
rk AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1)/2 AS r FROM j)
SELECT lang, round(coalesce((sum(r) FILTER (y = 1) - sum(y)*(sum(y)+1)/2)/nullif(sum(y)*(count(*)-sum(y)), 0), 0.5), 6) AS auc FROM rk GROUP BY 1""")
def _(t):
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return rounded(M.auc(d, "quality", "n_chars", ["lang"]), ["lang"], ["auc"])


@query("M07_isotonic")
def _(t):
    d = predicted(t)
    m = M.fit_isotonic(d, "actual_points", "prediction")
    return M.apply_isotonic(d, m).select("player_id", "contest_id", r6("prediction", 4).alias("prediction"), r6("calibrated", 4).alias("calibrated"))


@query("M08_calibration_metrics", PRED + """
, rg AS (SELECT min(prediction) AS lo, max(prediction) + 1e-8 AS hi FROM pr),
b AS (SELECT least(floor((prediction - lo)/((hi-lo)/10)), 9) AS bin, count(*) AS n, abs(avg(prediction) - avg(actual_points)) AS e FROM pr, rg GROUP BY 1)
SELECT round((SELECT sum(e*n)/sum(n) FROM b), 6) AS ece, round(avg(abs(actual_points-prediction)), 6) AS mae, round(regr_slope(actual_points, prediction), 6) AS slope,
       round(regr_intercept(actual_points, prediction), 6) AS intercept, count(*) AS n_samples FROM pr""")
def _(t):
    m = M.calibration_metrics(predicted(t), "actual_points", "prediction")
    return m.select(*[r6(c).alias(c) for c in ("ece", "mae", "slope", "intercept")], "n_samples")


@query("M08_calibration_bins", PRED + """
, rg AS (SELECT min(prediction) AS lo, max(prediction) + 1e-8 AS hi FROM pr)
SELECT least(floor((prediction - lo)/((hi-lo)/10)), 9)::INT AS bin, count(*) AS n, round(avg(prediction), 6) AS mean_pred, round(avg(actual_points), 6) AS mean_true FROM pr, rg GROUP BY 1""")
def _(t):
    return rounded(M.calibration_bins(predicted(t), "actual_points", "prediction"), ["bin", "n"], ["mean_pred", "mean_true"])


@query("M09_bagged_prediction")
def _(t):
    b = M.bagged_ridge(t.players, X2, "actual_points", members=25)
    p = M.bagged_prediction(t.players.select("player_id", "contest_id", *X2), b, X2)
    return rounded(p, ["player_id", "contest_id"], ["pred_mean", "pred_std"])


@query("M10_partial_pooling", PRED + """
, k AS (SELECT *, CASE WHEN multi_entry_max > 1 THEN 'MME' WHEN contest_size <= 20 THEN 'SE' ELSE 'limited' END AS ct FROM pr),
a AS (SELECT ct, avg(actual_points-prediction)*count(*)/(count(*)+10) AS adj FROM k GROUP BY 1)
SELECT player_id, contest_id, ct, round(least(greatest(prediction + adj, 0), 100), 6) AS pooled FROM k JOIN a USING (ct)""")
def _(t):
    from ledgerfold.operators.returns import archetype
    d = predicted(t).withColumn("ct", archetype(taxonomy="features"))
    a = M.pooling_adjustments(d, "ct", "actual_points", "prediction")
    return rounded(M.apply_pooling(d, a, "ct", "prediction"), ["player_id", "contest_id", "ct"], ["pooled"])


HOLD = EV + ", tr AS (SELECT p.* FROM players p JOIN ev USING (date_id) WHERE no <= total - 10)" + RIDGE.format(by="", src="tr", a="1.0::DOUBLE") + """
, te AS (SELECT 1 AS one, date_id, abs(actual_points - least(greatest(my - w1*m1 - w2*m2 + w1*close_prob + w2*ownership, 0), 100)) AS ae FROM players JOIN ev USING (date_id), cf WHERE no > total - 10)
"""


@query("M11_holdout_evaluation", HOLD + bootstrap_sql("one", "te", 1000, "ae", "1.0::DOUBLE") + """
SELECT 'mae' AS metric, round(point_estimate, 4) AS point_estimate, round(ci_lower, 4) AS ci_lower, round(ci_upper, 4) AS ci_upper, n_events, n_samples FROM boot""")
def _(t):
    m = M.holdout_evaluation(t.players, X2, "actual_points", draws=1000).where("metric = 'mae'")
    return m.select("metric", *[r6(c, 4).alias(c) for c in ("point_estimate", "ci_lower", "ci_upper")], "n_events", "n_samples")


@query("V06_event_metric_interval", PRED + ", er AS (SELECT 1 AS one, date_id, pow(actual_points-prediction, 2) AS se FROM pr)"
       + bootstrap_sql("one", "er", 1000, "se", "1.0::DOUBLE") + """
SELECT round(sqrt(point_estimate), 6) AS rmse, round(sqrt(ci_lower), 6) AS ci_lower, round(sqrt(ci_upper), 6) AS ci_upper, n_events FROM boot""")
def _(t):
    m = M.event_metric_interval(predicted(t), "actual_points", "prediction", "rmse", draws=1000)
    # sqrt of an interpolated squared interval, as the oracle takes it
    return m.select(r6("point_estimate").alias("rmse"), r6("ci_lower").alias("ci_lower"), r6("ci_upper").alias("ci_upper"), "n_events")


# Poisson(1) weights written out for SQL, apart from the operator: F(k) = sum of 1/(e i!)
_CDF = [sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(12)]
WT = "(" + " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in _CDF) + ")"
_HEX = "('0x'||substr(md5('42|'||player_id||'|'||contest_id),{},8))::UBIGINT::BIGINT"
SEEDS = f"{_HEX.format(1)} AS s1, {_HEX.format(9)} AS s2"
DRAW = "((s1 + s2*b) % 2147483647)::DOUBLE / 2147483647.0::DOUBLE AS u"


@query("V07_row_bootstrap_rmse", PRED + f"""
, sd AS (SELECT pow(actual_points-prediction, 2) AS se, {SEEDS} FROM pr),
rp AS (SELECT b, se, {DRAW} FROM sd, (SELECT unnest(range(1000)) AS b)),
w AS (SELECT b, se, {WT} AS wt FROM rp),
x AS (SELECT b, sqrt(sum(se*wt)/sum(wt)) AS x FROM w GROUP BY 1)
SELECT round((SELECT sqrt(avg(pow(actual_points-prediction, 2))) FROM pr), 4) AS rmse, round(quantile_cont(x, 0.025), 4) AS ci_lower, round(quantile_cont(x, 0.975), 4) AS ci_upper FROM x""")
def _(t):
    b = I.row_bootstrap_rmse(predicted(t), ["player_id", "contest_id"], "actual_points", "prediction", draws=1000)
    return b.select(r6("rmse", 4).alias("rmse"), r6("ci_lower", 4).alias("ci_lower"), r6("ci_upper", 4).alias("ci_upper"))


@query("V07_row_bootstrap_auc", f"""
, sd AS (SELECT (actual_points > 50)::INT AS y, close_prob AS p, {SEEDS} FROM players),
rp AS (SELECT b, y, p, {DRAW} FROM sd, (SELECT unnest(range(1000)) AS b)),
w AS (SELECT b, p, sum({WT}*y) AS wp, sum({WT}) AS wn FROM rp GROUP BY 1, 2),
r AS (SELECT *, sum(wn) OVER (PARTITION BY b ORDER BY p) - wn + (wn + 1)/2 AS mr FROM w),
x AS (SELECT (sum(mr*wp) - sum(wp)*(sum(wp)+1)/2)/(sum(wp)*(sum(wn)-sum(wp))) AS x FROM r GROUP BY b)
SELECT round(quantile_cont(x, 0.025), 6) AS ci_lower, round(quantile_cont(x, 0.975), 6) AS ci_upper, round(stddev_pop(x), 6) AS std FROM x""")
def _(t):
    d = t.players.select("player_id", "contest_id", "close_prob", (F.col("actual_points") > 50).cast("int").alias("y"))
    return rounded(I.row_bootstrap_auc(d, ["player_id", "contest_id"], "y", "close_prob", draws=1000), [], ["ci_lower", "ci_upper", "std"])


# ---- explanation ----------------------------------------------------------------


def rule(extra: str = ""):
    """The fixed formula as a predict function."""
    return X.column_model(F.expr(FORMULA + extra))


KEY = ["player_id", "contest_id"]


REPEATS = 10


def swap_sql(col, seed=42, src="players"):
    """Mean error per repeat with ``col`` taken from the row a drawn shift further on in hash order."""
    return f"""SELECT '{col}' AS feature, rep, avg(abs(actual_points - {FSQL.replace(col, 's.v')})) AS e FROM
  (SELECT *, (h.place + ('0x'||substr(md5('{seed}|'||rep||'|{col}'),1,8))::UBIGINT::BIGINT % greatest(h.n-1, 1) + 1) % h.n AS src_at FROM {src}_h h, (SELECT unnest(range({REPEATS})) AS rep)) b
  JOIN (SELECT place AS src_at, {col} AS v FROM {src}_h) s USING (src_at) GROUP BY rep"""


def hashed_sql(src, seed=42):
    return f"""{src}_h AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}|'||player_id||'|'||contest_id), player_id, contest_id) - 1 AS place, count(*) OVER () AS n FROM {src})"""


@query("I01_permutation_importance", f"""
, {hashed_sql('players')}, r AS ({swap_sql('close_prob')} UNION ALL {swap_sql('ownership')}), b AS (SELECT avg(abs(actual_points - {FSQL})) AS e0 FROM players)
SELECT feature, round(avg(e - e0), 6) AS importance, round(stddev_pop(e - e0), 6) AS std FROM r, b GROUP BY 1""")
def _(t):
    d = t.players.select(*KEY, "close_prob", "ownership", "actual_points")
    return rounded(X.permutation_importance(d, rule(), KEY, ["close_prob", "ownership"], "actual_points", repeats=REPEATS), ["feature"], ["importance", "std"])


@query("I02_fold_stable_importance", RIDGE_FOLDS + f"""
, te AS (SELECT player_id, contest_id, no - 21 AS fold, close_prob, ownership, actual_points, my - w1*m1 - w2*m2 AS w0, w1, w2
         FROM players p JOIN cf ON p.date_id = test JOIN ev USING (date_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5((42+fold)||'|'||player_id||'|'||contest_id), player_id, contest_id) - 1 AS place, count(*) OVER (PARTITION BY fold) AS n FROM te),
b AS (SELECT fold, avg(abs(actual_points - least(greatest(w0 + w1*close_prob + w2*ownership, 0), 100))) AS e0 FROM te GROUP BY 1),
sh AS (SELECT h.*, f, rep, (place + ('0x'||substr(md5((42+fold)||'|'||rep||'|'||f),1,8))::UBIGINT::BIGINT % greatest(n-1, 1) + 1) % n AS src_at
       FROM h, (SELECT unnest(['close_prob', 'ownership']) AS f), (SELECT unnest(range({REPEATS})) AS rep)),
e AS (SELECT sh.fold, f, rep, avg(abs(sh.actual_points - least(greatest(sh.w0 + sh.w1*CASE f WHEN 'close_prob' THEN s.close_prob ELSE sh.close_prob END
        + sh.w2*CASE f WHEN 'ownership' THEN s.ownership ELSE sh.ownership END, 0), 100))) AS e FROM sh JOIN h s ON s.fold = sh.fold AND s.place = sh.src_at GROUP BY 1, 2, 3),
i AS (SELECT fold, f AS feature, avg(e - e0) AS imp FROM e JOIN b USING (fold) GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY imp DESC) + (count(*) OVER (PARTITION BY fold, imp) - 1)/2 AS rk FROM i)
SELECT feature, round(avg(imp), 6) AS mean_importance, round(stddev_samp(imp), 6) AS std_importance, round(avg(rk), 6) AS mean_rank, round(stddev_samp(rk), 6) AS std_rank,
       round(1 - stddev_samp(rk)/2, 6) AS rank_stability FROM k GROUP BY 1""")
def _(t):
    cv = M.ridge_walk_forward(t.players, X2, "actual_points", min_train=P.MIN_TRAIN_EVENTS).select(*KEY, "fold", "coef", *X2, "actual_points")
    own = X.column_model(M.clip(M.linear_prediction(F.col("coef"), X2), 0.0, 100.0))  # every fold's own fit
    per_fold = X.permutation_importance(cv, own, KEY, X2, "actual_points", repeats=REPEATS, fold="fold")
    return rounded(X.fold_importance(per_fold), ["feature"], ["mean_importance", "std_importance", "mean_rank", "std_rank", "rank_stability"])


@query("I03_partial_dependence", f"""
, q AS (SELECT quantile_cont(close_prob, 0.05) AS lo, quantile_cont(close_prob, 0.95) AS hi FROM players), g AS (SELECT lo + (hi-lo)*i/49 AS v FROM q, (SELECT unnest(range(50)) AS i))
SELECT round(v, 6) AS grid_value, round(avg({FSQL.replace('close_prob', 'v')}), 6) AS pd FROM players, g GROUP BY v""")
def _(t):
    d = t.players.select("close_prob", "ownership")
    return rounded(X.partial_dependence(d, rule(), "close_prob", grid=50), [], ["grid_value", "pd"])


@query("I03_partial_dependence_2d", f"""
, q AS (SELECT min(close_prob) AS a, max(close_prob) AS b, min(ownership) AS c, max(ownership) AS d FROM players),
g AS (SELECT a + (b-a)*i/24 AS v1, c + (d-c)*j/24 AS v2 FROM q, (SELECT unnest(range(25)) AS i), (SELECT unnest(range(25)) AS j))
SELECT round(v1, 6) AS v1, round(v2, 6) AS v2, round({FSQL.replace('close_prob', 'v1').replace('ownership', 'v2')}, 6) AS pd FROM g""")
def _(t):
    d = t.players.select("close_prob", "ownership")
    return rounded(X.partial_dependence_2d(d, rule(), "close_prob", "ownership", grid=25), [], ["v1", "v2", "pd"])


@query("I04_accumulated_local_effects", f"""
, q AS (SELECT list_sort(list_distinct(quantile_cont(close_prob, [x/50 for x in range(51)]))) AS ed FROM players),
b AS (SELECT *, least(greatest(len(list_filter(ed, lambda x: x <= close_prob)) - 1, 0), len(ed) - 2)::INT AS bin FROM players, q),
l AS (SELECT bin, any_value(ed[bin+1]) AS a, any_value(ed[bin+2]) AS z, avg({FSQL.replace('close_prob', 'ed[bin+2]')} - {FSQL.replace('close_prob', 'ed[bin+1]')}) AS d FROM b GROUP BY 1),
c AS (SELECT bin, (a+z)/2 AS center, sum(d) OVER (ORDER BY bin) AS s FROM l)
SELECT bin, round(center, 6) AS center, round(s - avg(s) OVER (), 6) AS ale FROM c""")
def _(t):
    d = t.players.select("close_prob", "ownership")
    return rounded(X.ale(d, rule(), "close_prob", 50), ["bin"], ["center", "ale"])


H_FEATURES = ["close_prob", "ownership", "salary"]


def h_sql():
    """Variances of all one-way (5 % to 95 %) and two-way (min to max) grids of 20 steps, then H per pair."""
    f = FSQL[:-1] + " + salary/1000::DOUBLE)"
    at = lambda c, lo, hi, i: f"(SELECT {lo} + ({hi} - {lo})*{i}/19 FROM (SELECT quantile_cont({c}::DOUBLE, 0.05) AS p5, quantile_cont({c}::DOUBLE, 0.95) AS p95, min({c}) AS mn, max({c}) AS mx FROM players))"
    axis = lambda n, c, lo, hi: f"{n}_{c} AS (SELECT i, {at(c, lo, hi, 'i')} AS v FROM (SELECT unnest(range(20)) AS i))"
    axes = [axis(n, c, *e) for c in H_FEATURES for n, e in (("a", ("p5", "p95")), ("c", ("mn", "mx")))]
    put = lambda text, c, v: re.sub(rf"\b{c}\b", v, text)
    ones = [f"SELECT '{c}' AS a, NULL AS b, var_pop(m) AS v FROM (SELECT avg({put(f, c, 'g.v')}) AS m FROM players, a_{c} g GROUP BY g.i)" for c in H_FEATURES]
    twos = [f"SELECT '{c}' AS a, '{d}' AS b, var_pop(m) AS v FROM (SELECT avg({put(put(f, c, 'g.v'), d, 'k.v')}) AS m FROM players, c_{c} g, c_{d} k GROUP BY g.i, k.i)"
            for c, d in combinations(H_FEATURES, 2)]
    return ", " + ", ".join(axes) + ", hv AS (" + " UNION ALL ".join(ones + twos) + """)
SELECT p.a AS feature1, p.b AS feature2, round(greatest(0, (p.v - x.v - y.v)/p.v), 6) AS h FROM hv p JOIN hv x ON x.a = p.a AND x.b IS NULL JOIN hv y ON y.a = p.b AND y.b IS NULL"""


@query("I05_interactions", h_sql())
def _(t):
    return rounded(X.interactions(t.players.select(*H_FEATURES), rule(" + salary / 1000"), H_FEATURES), ["feature1", "feature2"], ["h"])


@query("I06_linear_attribution", """
, m AS (SELECT avg(close_prob) AS mp, avg(ownership) AS mo FROM players)
SELECT player_id, contest_id, round(60*(close_prob - mp), 6) AS attr_close_prob, round(0.5::DOUBLE*(ownership - mo), 6) AS attr_ownership FROM players, m""")
def _(t):
    return rounded(X.linear_attribution(t.players, {"close_prob": 60, "ownership": 0.5}), KEY, ["attr_close_prob", "attr_ownership"])


@query("I06_global_attribution", """
, m AS (SELECT avg(close_prob) AS mp, avg(ownership) AS mo FROM players)
SELECT 'close_prob' AS feature, round(avg(abs(60*(close_prob - mp))), 6) AS mean_abs FROM players, m UNION ALL SELECT 'ownership', round(avg(abs(0.5::DOUBLE*(ownership - mo))), 6) FROM players, m""")
def _(t):
    a = X.linear_attribution(t.players, {"close_prob": 60, "ownership": 0.5})
    return rounded(X.global_attribution(a, ["close_prob", "ownership"]), ["feature"], ["mean_abs"])


@query("P23_leakage_keywords", """
, r AS (SELECT 'ownership' AS feature, abs(corr(ownership, actual_points)) AS importance FROM players UNION ALL SELECT 'payout_rank', abs(corr(salary, actual_points)) FROM players
 UNION ALL SELECT 'close_prob', abs(corr(close_prob, actual_points)) FROM players)
SELECT feature, round(importance, 6) AS importance FROM r WHERE feature = 'payout_rank'""")
def _(t):
    one = t.players.agg(F.abs(F.corr("ownership", "actual_points")).alias("ownership"), F.abs(F.corr("salary", "actual_points")).alias("payout_rank"),
                        F.abs(F.corr("close_prob", "actual_points")).alias("close_prob"))
    imp = one.unpivot([], ["ownership", "payout_rank", "close_prob"], "feature", "importance")
    return rounded(X.leakage_keywords(imp, ["payout", "cash", "result"]), ["feature"], ["importance"])


# ---- strategies ---------------------------------------------------------------------
GRID = S.param_grid({"slope": [20.0, 40.0, 60.0], "base": [10.0, 30.0]})
TR_SQL = ", tr AS (" + " UNION ALL ".join(
    f"SELECT {i + 1} AS trial, player_id, contest_id, date_id, (actual_points - ({p['base']}::DOUBLE + {p['slope']}::DOUBLE*close_prob))/(abs({p['base']}::DOUBLE + {p['slope']}::DOUBLE*close_prob) + 1e-8) AS r FROM players"
    for i, p in enumerate(GRID)) + """),
mt AS (SELECT trial, count(*) AS n_trades, sum(r) AS total_return, avg((r > 0)::INT) AS win_rate, (avg(r)*52 - 0.02::DOUBLE)/(stddev_samp(r)*sqrt(52)) AS sharpe, stddev_pop(r) AS std_return,
  sum(CASE WHEN r > 0 THEN r END)/abs(sum(CASE WHEN r < 0 THEN r END)) AS profit_factor, avg(r) AS mu FROM tr GROUP BY 1)"""


def trial_returns(t):
    d = S.with_trials(t.players, GRID, lambda p: p["base"] + p["slope"] * F.col("close_prob"))
    return d.withColumn("r", S.strategy_return("actual_points", "prediction", F.lit(1.0)))


def trials(t):
    return S.risk_metrics(trial_returns(t), ["trial"], "r")


@query("T01_strategy_returns", TR_SQL + "SELECT trial, n_trades, round(total_return, 4) AS total_return, round(win_rate, 6) AS win_rate FROM mt")
def _(t):
    return trials(t).select("trial", "n_trades", r6("total_return", 4).alias("total_return"), r6("win_rate").alias("win_rate"))


@query("T02_sharpe", TR_SQL + "SELECT trial, round(sharpe, 6) AS sharpe FROM mt")
def _(t):
    return rounded(trials(t), ["trial"], ["sharpe"])


@query("T03_moments_and_profit_factor", TR_SQL + """
, z AS (SELECT trial, avg(pow((r - mu)/std_return, 3)) AS skew, avg(pow((r - mu)/std_return, 4)) - 3 AS kurtosis FROM tr JOIN mt USING (trial) GROUP BY 1)
SELECT trial, round(std_return, 6) AS std_return, round(skew, 6) AS skew, round(kurtosis, 5) AS kurtosis, round(profit_factor, 6) AS profit_factor FROM mt JOIN z USING (trial)""")
def _(t):
    m = trials(t)
    return m.select("trial", *[r6(c).alias(c) for c in ("std_return", "skew")], r6("kurtosis", 5).alias("kurtosis"), r6("profit_factor").alias("profit_factor"))


@query("T04_drawdown", TR_SQL + """
, q AS (SELECT trial, date_id, contest_id, player_id, sum(r) OVER (PARTITION BY trial ORDER BY date_id, contest_id, player_id) AS eq FROM tr),
d AS (SELECT trial, max(eq) OVER (PARTITION BY trial ORDER BY date_id, contest_id, player_id) - eq AS dd FROM q)
SELECT trial, round(max(dd), 4) AS max_drawdown, round(any_value(total_return)/max(dd), 4) AS calmar FROM d JOIN mt USING (trial) GROUP BY 1""")
def _(t):
    returns = [S.strategy_return("actual_points", p["base"] + p["slope"] * F.col("close_prob"), F.lit(1.0)) for p in GRID]
    d = t.players.select("date_id", "contest_id", "player_id", "actual_points", "close_prob")
    b = S.backtest_of(d, "trial", list(range(1, len(GRID) + 1)), ["date_id", "contest_id", "player_id"], returns)
    return rounded(b, ["trial"], ["max_drawdown", "calmar"], 4)


def _emax(n: int) -> float:
    """Expected best of n by the standard library's normal, independent of ours."""
    from math import e
    from statistics import NormalDist
    z = NormalDist().inv_cdf
    return (1 - S.EULER_GAMMA) * z(1 - 1 / n) + S.EULER_GAMMA * z(1 - 1 / (n * e))


def cdf_sql(z: str) -> str:
    """Abramowitz and Stegun 26.2.17 in SQL."""
    k = f"(1/(1 + 0.2316419::DOUBLE*abs({z})))"
    poly = f"({k}*(0.319381530::DOUBLE + {k}*(-0.356563782::DOUBLE + {k}*(1.781477937::DOUBLE + {k}*(-1.821255978::DOUBLE + {k}*1.330274429::DOUBLE)))))"
    up = f"(exp(-({z})*({z})/2)/sqrt(2*pi())*{poly})"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {up} ELSE {up} END)"


_VAR = "(1 + 0.5::DOUBLE*sharpe*sharpe)"
_E6 = f"{_emax(6)!r}::DOUBLE"


@query("T05_deflated_sharpe", TR_SQL + f""", z AS (SELECT *, (sharpe - {_E6})/sqrt({_VAR}/5) AS z1, (sharpe - {_E6})/sqrt({_VAR}) AS z2 FROM mt)
SELECT trial, round(sharpe, 6) AS sharpe, round({cdf_sql('z1')}, 6) AS deflated, round({cdf_sql('z2')}, 6) AS undivided FROM z""")
def _(t):
    m = trials(t)
    return m.select("trial", r6("sharpe").alias("sharpe"), r6(S.deflated_sharpe("sharpe", F.lit(len(GRID)))).alias("deflated"),
                    r6(S.deflated_sharpe("sharpe", F.lit(len(GRID)), variant="undivided")).alias("undivided"))


_EM = "CASE trial " + " ".join(f"WHEN {i} THEN {_emax(i)!r}::DOUBLE" for i in range(2, 7)) + " END"


@query("T06_parameter_grid_backtest", TR_SQL + f""", z AS (SELECT *, (sharpe - {_EM})/sqrt({_VAR}/greatest(trial - 1, 1)) AS z FROM mt),
d AS (SELECT trial, sharpe, CASE WHEN trial = 1 THEN (sharpe > 0)::INT::DOUBLE ELSE {cdf_sql('z')} END AS ds FROM z)
SELECT trial, round(sharpe, 6) AS sharpe, round(ds, 6) AS deflated_sharpe, trial AS n_trials FROM d ORDER BY ds DESC, trial LIMIT 5""")
def _(t):
    return S.rank_trials(trials(t), top=5).select("trial", r6("sharpe").alias("sharpe"), r6("deflated_sharpe").alias("deflated_sharpe"), "n_trials")


@query("T07_trial_log", TR_SQL + """
SELECT trial, round(sharpe, 6) AS sharpe, round(max(sharpe) OVER (ORDER BY trial), 6) AS best_so_far, count(*) OVER (ORDER BY trial) AS total_trials FROM mt""")
def _(t):
    log = S.trial_log(trials(t), F.struct("trial"))
    return log.select("trial", r6("sharpe").alias("sharpe"), r6("best_so_far").alias("best_so_far"), "total_trials")


@query("T08_walk_forward_backtest", EV + """
, tr AS (SELECT f.no AS fno, f.date_id AS test, p.* EXCLUDE (date_id) FROM ev f JOIN ev e ON e.no < f.no JOIN players p ON p.date_id = e.date_id WHERE f.no > 20)
""" + RIDGE.format(by="test,", src="tr GROUP BY test", a="1.0::DOUBLE") + """
, pr AS (SELECT test, p.actual_points AS y, least(greatest(my - w1*m1 - w2*m2 + w1*close_prob + w2*ownership, 0), 100) AS yh FROM players p JOIN cf ON p.date_id = test),
re AS (SELECT test, (y - yh)/(abs(yh) + 1e-8) AS r FROM pr)
SELECT (no - 21)::INT AS fold, count(*) AS n_trades, round(sum(r), 4) AS total_return, round((avg(r)*52 - 0.02::DOUBLE)/(stddev_samp(r)*sqrt(52)), 4) AS sharpe FROM re JOIN ev ON date_id = test GROUP BY no""")
def _(t):
    p = M.ridge_walk_forward(t.players, X2, "actual_points", min_train=P.MIN_TRAIN_EVENTS)
    m = S.risk_metrics(p.withColumn("r", S.strategy_return("actual_points", "prediction", F.lit(1.0))), ["fold"], "r")
    return m.select("fold", "n_trades", r6("total_return", 4).alias("total_return"), r6("sharpe", 4).alias("sharpe"))
