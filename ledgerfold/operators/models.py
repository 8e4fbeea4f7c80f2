"""Estimators, walk-forward evaluation, calibration and pooling.

Linear models never loop over folds: sums of products per event are one
aggregate, fold totals are running sums over events, and each fold is a small
k x k solve inside a task.  Trees over folds are in ``trees``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerfold import presets as P
from ledgerfold.functions.scalars import clip
from ledgerfold.operators import folds as V, inference as I, ordered as O, trees as T
from ledgerfold.operators.returns import ratio
from ledgerfold.operators.ordered import attach_row


# --- preprocessing and estimators -------------------------------------------

class MedianImputer(Estimator):
    """Fill missing numbers (null or NaN) with the exact lower median.

    The medians come from distributed positions: a quantile sketch of error
    zero would hold every value, and merge all of them on the driver.
    """

    def __init__(self, cols: Sequence[str], outputs: Sequence[str]):
        super().__init__()
        self.cols, self.outputs = list(cols), list(outputs)

    def _fit(self, df: DataFrame) -> Transformer:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in self.cols]))
        pos = O.value_positions(df.select(each.alias("e")).select("e.*").where(~F.isnan("x")), ["f"], "x")
        sized = pos.join(pos.groupBy("f").agg(F.sum("_n").alias("_size")), "f")
        half = F.floor((F.col("_size") + 1) / 2)
        middle = sized.where((F.col("_cum") - F.col("_n") < half) & (F.col("_cum") >= half)).select("f", "x").collect()  # one row a column
        found = {r["f"]: r["x"] for r in middle}
        lacking = [c for c in self.cols if c not in found]
        if lacking:
            raise ValueError(f"no value to take a median of: {', '.join(lacking)}")
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        name = lambda c: "`" + c.replace("`", "``") + "`"
        filled = [f"coalesce(if(isnan({name(c)}), null, {name(c)}), cast(double('{found[c]!r}') as {kinds[c]})) as {name(o)}" for c, o in zip(self.cols, self.outputs)]
        return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def preprocessing(numeric: Sequence[str], categorical: Sequence[str] = (), out: str = "features") -> list:
    """Median impute and scale numbers; index and one-hot categories.

    Unseen categories at transform time get their own slot instead of failing.
    """
    filled = [f"{c}__f" for c in numeric]
    stages = [
        MedianImputer(numeric, filled),
        VectorAssembler(inputCols=filled, outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_numz", withMean=True, withStd=True),
    ]
    parts = ["_numz"]
    if categorical:
        idx = [f"{c}__i" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=[f"{c}__h" for c in categorical], handleInvalid="keep")]
        parts += [f"{c}__h" for c in categorical]
    return stages + [VectorAssembler(inputCols=parts, outputCol=out)]


def scaled(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_z`` (exact median where missing, then mean 0 and deviation 1) and
    ``<c>_slot``, the place of a category among the sorted ones (null: null).

    A constant column gives 0.  Medians and moments are one-row tables; the
    categories meet the rows in a join, so their number is not bounded.
    """
    for c in numeric:
        df = df.transform(attach_row, O.percentiles(df, [], c, {f"_md_{c}": 0.5}))
    full = df.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), f"_md_{c}") for c in numeric})
    moments = full.agg(*[f(f"_x_{c}").alias(f"_{n}_{c}") for c in numeric for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    out = full.transform(attach_row, moments) if numeric else full
    out = out.withColumns({f"{c}_z": F.coalesce(F.try_divide(F.col(f"_x_{c}") - F.col(f"_mu_{c}"), F.col(f"_sd_{c}")), F.lit(0.0)) for c in numeric})
    out = out.drop(*[f"_{p}_{c}" for c in numeric for p in ("md", "x", "mu", "sd")])
    for c in categorical:
        slots = O.running(df.where(F.col(c).isNotNull()).select(c).distinct(), [], [c], number=f"{c}_slot")
        out = out.join(slots.withColumn(f"{c}_slot", F.col(f"{c}_slot") - 1), c, "left")
    return out


def estimator(kind: str, label: str, features: str = "features", **kw):
    """``ridge``, ``forest``, ``boosted`` or ``logistic`` with the engine's defaults."""
    base = {"featuresCol": features, "labelCol": label}
    if kind == "ridge":
        # The objective wanted is RSS + alpha*|w|^2; Spark divides the loss
        # by 2n and scales by the label's deviation, see ridge_reg_param.
        return LinearRegression(**base, elasticNetParam=0.0, standardization=False, solver="l-bfgs", tol=1e-12,
                                maxIter=500, regParam=kw.pop("reg_param", 0.0), **kw)
    if kind == "forest":
        return RandomForestRegressor(**base, seed=P.SEED, **{"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5, **kw})
    if kind == "boosted":
        return GBTRegressor(**base, seed=P.SEED, **{"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
                                           "minInstancesPerNode": 10, "featureSubsetStrategy": "0.8", **kw})
    if kind == "logistic":
        return LogisticRegression(**base, **kw)
    raise ValueError(f"unknown estimator {kind}")


def ridge_reg_param(df: DataFrame, label: str, alpha: float) -> float:
    """Spark ``regParam`` equivalent to penalty ``alpha`` on the residual sum."""
    r = df.agg(F.stddev_samp(label).alias("s"), F.count(label).alias("n")).first()
    return alpha * r["s"] / r["n"]


def clipped(df: DataFrame, col: str = "prediction", lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Clamp predictions to the target's range."""
    return df.withColumn(col, clip(col, lo, hi))


# --- linear models from sums of products -------------------------------------

def event_gram(df: DataFrame, features: Sequence[str], target: str, event: Sequence[str] | str) -> DataFrame:
    """Upper triangle of sums of products of ``[1, x..., y]`` per event."""
    by = [event] if isinstance(event, str) else list(event)
    names = ["_one", *features, target]
    full = df.dropna(subset=[*features, target]).withColumn("_one", F.lit(1.0))
    cells = [F.coalesce(F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")), F.lit(0.0)).alias(f"g{i}_{j}")
             for i in range(len(names)) for j in range(i, len(names))]
    return full.groupBy(*by).agg(*cells)


def _gram_cols(k: int) -> list[str]:
    return [f"g{i}_{j}" for i in range(k + 2) for j in range(i, k + 2)]


def solve_ridge(k: int, alpha: float):
    """Pandas UDF: flat gram -> ``[intercept, w_1..w_k]`` with standardised penalty."""

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series) -> pd.Series:
        iu = np.triu_indices(k + 2)
        out = []
        for flat in g:
            m = np.zeros((k + 2, k + 2))
            m[iu] = flat
            m = m + np.triu(m, 1).T
            n = m[0, 0]
            if n < 1:
                out.append(None)
                continue
            mu = m[0, 1:] / n
            c = m[1:, 1:] - n * np.outer(mu, mu)
            s = np.sqrt(np.maximum(np.diag(c)[:k] / n, 0))
            s[s == 0] = 1.0
            a = c[:k, :k] / np.outer(s, s) + alpha * np.eye(k)
            w = np.linalg.lstsq(a, c[:k, k] / s, rcond=None)[0] / s
            out.append([float(mu[k] - mu[:k] @ w), *map(float, w)])
        return pd.Series(out)

    return solve


def linear_prediction(coef: Column, features: Sequence[str]) -> Column:
    """Intercept plus dot product as a plain column expression."""
    total = coef[0]
    for i, f in enumerate(features):
        total = total + coef[i + 1] * F.col(f)
    return total


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> DataFrame:
    """One row (coef array): exact ridge from one aggregate."""
    k = len(features)
    g = event_gram(df, features, target, [])
    return g.select(solve_ridge(k, alpha)(F.array(*_gram_cols(k))).alias("coef"), F.col("g0_0").cast("long").alias("n_rows"))


def ridge_walk_forward(
    df: DataFrame, features: Sequence[str], target: str, event: str = "date_id", *, alpha: float = 1.0,
    min_train: int = P.MIN_TRAIN_EVENTS, lo: float = 0.0, hi: float = 100.0,
) -> DataFrame:
    """Predictions of every walk-forward fold from one pass over the data.

    Running sums over events (one row per date) give each fold's training
    matrix; test rows meet their fold's coefficients by date.
    """
    k = len(features)
    cols = _gram_cols(k)
    w = Window.partitionBy(F.lit(1)).orderBy(event)  # one row per date
    per = event_gram(df, features, target, event)
    cum = per.select(event, (F.row_number().over(w) - 1).alias("_seen"),
                     F.array(*[F.sum(c).over(w) - F.col(c) for c in cols]).alias("_g"))
    fits = cum.where(F.col("_seen") >= min_train).select(
        event, (F.col("_seen") - min_train).cast("int").alias("fold"), solve_ridge(k, alpha)("_g").alias("coef"))
    out = df.dropna(subset=[*features, target]).join(fits, event)
    return out.withColumn("prediction", clip(linear_prediction(F.col("coef"), features), lo, hi))


def bagged_ridge(
    df: DataFrame, features: Sequence[str], target: str, event: str = "date_id", *, members: int = 50, alpha: float = 1.0,
    seed: int = P.SEED,
) -> DataFrame:
    """(b, coef): ridge refitted on ``members`` event resamples, one pass over data."""
    k = len(features)
    cols = _gram_cols(k)
    per = event_gram(df, features, target, event)
    w = Window.partitionBy(F.lit(1)).orderBy(event)  # one row per date
    ranked = per.withColumn("_pos", (F.row_number().over(w) - 1).cast("long")).withColumn(
        "n_events", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    draws = I.draw_counts(ranked, members, seed)
    g = ranked.join(draws, ["n_events", "_pos"]).groupBy("_rep").agg(*[F.sum(F.col(c) * F.col("_times")).alias(c) for c in cols])
    return g.select("_rep", solve_ridge(k, alpha)(F.array(*cols)).alias("coef"))


def bagged_prediction(df: DataFrame, bags: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and spread of the bagged members' predictions per row.

    The member coefficients are ``members`` short arrays packed into one row;
    each data row evaluates them in place.
    """
    packed = bags.agg(F.sort_array(F.collect_list(F.struct("_rep", "coef"))).alias("_all"))  # one row, `members` arrays
    preds = F.transform("_all", lambda m: linear_prediction(m["coef"], features))
    d = df.transform(attach_row, packed).withColumn("_p", preds)
    mean = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) / F.size("_p")
    d = d.withColumn("pred_mean", mean)
    var = F.aggregate(F.transform("_p", lambda x: F.pow(x - F.col("pred_mean"), 2)), F.lit(0.0), lambda a, x: a + x) / F.size("_p")
    return d.withColumn("pred_std", F.sqrt(var)).drop("_p", "_all")


# --- metrics -------------------------------------------------------------------

def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2, MAPE, means, calibration ratio and row count."""
    e = F.col(yhat) - F.col(y)
    sse = F.sum(e * e)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - ratio(sse, F.var_pop(y) * F.count(y))).alias("r2"),
        (100 * F.avg(F.abs(F.try_divide(e, F.col(y) + 1e-8)))).alias("mape"),
        F.avg(yhat).alias("mean_pred"), F.avg(y).alias("mean_actual"), ratio(F.avg(yhat), F.avg(y)).alias("calibration_ratio"),
        F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sum, exact with ties, any data size."""
    pos = df.groupBy(*by, score).agg(F.sum(F.col(label)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    run = O.running(pos, by, [score], sums={"_cum": "_n"})
    mean_rank = F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2
    a = run.groupBy(*by).agg(F.sum(mean_rank * F.col("_p")).alias("_r"), F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    neg = F.col("_N") - F.col("_P")
    return a.select(*by, F.coalesce(F.try_divide(F.col("_r") - F.col("_P") * (F.col("_P") + 1) / 2, F.col("_P") * neg), F.lit(0.5)).alias("auc"))


def binary_metrics(df: DataFrame, label: str, prob: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, log loss and AUC."""
    y, p = F.col(label), F.col(prob)
    hit = (p >= threshold).cast("int")
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    m = df.agg(F.avg((hit == y).cast("double")).alias("accuracy"),
               F.coalesce(ratio(F.sum(hit * y), F.sum(hit)), F.lit(0.0)).alias("precision"),
               F.coalesce(ratio(F.sum(hit * y), F.sum(y)), F.lit(0.0)).alias("recall"),
               F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.count(F.lit(1)).alias("n"))
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return m.withColumn("f1", f1).transform(attach_row, auc(df, label, prob))


def event_metric_interval(df: DataFrame, y: str, yhat: str, metric: str = "mae", event: str = "date_id", **kw) -> DataFrame:
    """Event bootstrap of MAE or RMSE, from per-event error sums."""
    err = F.col(y) - F.col(yhat)
    num = F.abs(err) if metric == "mae" else err * err
    s = I.event_sums(df, [], event, {"num": num, "den": F.lit(1.0)})
    out = I.bootstrap_ratio(s, [], event, "num", "den", null_value=kw.pop("null_value", 0.0), **kw)
    if metric == "rmse":  # monotone, so the interval ends map over
        out = out.withColumns({c: F.sqrt(c) for c in ("point_estimate", "ci_lower", "ci_upper")}).drop("std", "p_value")
    return out


# --- model comparison and search -------------------------------------------------

def ensemble(df: DataFrame, models: Mapping[str, Transformer], lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Each model's clipped prediction and their mean."""
    out = df
    for name, m in models.items():
        cols = out.columns
        out = m.transform(out).select(*cols, clip("prediction", lo, hi).alias(f"pred_{name}"))
    mean = sum((F.col(f"pred_{n}") for n in models), F.lit(0.0)) / len(models)
    return out.withColumn("prediction", mean)


def compare_models(cv: DataFrame, y: str, complexity: Mapping[str, int]) -> DataFrame:
    """Mean and spread of fold RMSE per model and the one-standard-error pick.

    ``cv`` has (model, fold, y, prediction).  The pick is the simplest model
    within one fold deviation of the best.
    """
    per = regression_metrics(cv, y, "prediction", ["model", "fold"])
    m = per.groupBy("model").agg((-F.avg("rmse")).alias("cv_mean"), F.stddev_pop("rmse").alias("cv_std"), F.count(F.lit(1)).alias("n_folds"))
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in complexity.items() for x in kv]), F.col("model")), F.lit(999))
    w = Window.partitionBy(F.lit(1))  # one row per model
    m = m.withColumn("_cut", F.max_by(F.col("cv_mean") - F.col("cv_std"), F.col("cv_mean")).over(w)).withColumn("complexity", level)
    pick = F.row_number().over(w.orderBy((F.col("cv_mean") >= F.col("_cut")).desc(), "complexity", F.desc("cv_mean"), "model"))
    return m.withColumn("selected", pick == 1).drop("_cut")


def sample_params(grid: Mapping[str, Sequence], n: int, seed: int = P.SEED) -> list[dict]:
    """``n`` distinct random combinations of the grid."""
    import random
    from itertools import product
    combos = [dict(zip(grid, v)) for v in product(*grid.values())]
    return random.Random(seed).sample(combos, min(n, len(combos)))


def random_search(
    df: DataFrame, order: list[str], kind: str, target: str, params: Sequence[dict], numeric: Sequence[str], categorical: Sequence[str] = (), *,
    k: int = 3, gap: int = 0,
) -> DataFrame:
    """Forward-split score of each parameter set: (trial, params, cv_rmse).

    All trials share one binning and one table of cells; every (trial, fold) is a task.
    """
    import json
    numbered = V.number_rows(df, order)
    learners = {str(i): T.Learner(kind, **p) for i, p in enumerate(params)}
    cv = T.row_folds(numbered, learners, target, V.rolling_bounds(df.count(), k, gap=gap), numeric, categorical, lo=None)
    per = regression_metrics(cv, target, "prediction", ["model", "fold"]).groupBy("model").agg(F.avg("rmse").alias("cv_rmse"))
    text = F.create_map(*[F.lit(x) for i, p in enumerate(params) for x in (str(i), json.dumps(p, sort_keys=True))])
    return per.select(F.col("model").cast("int").alias("trial"), text[F.col("model")].alias("params"), "cv_rmse")


# --- calibration and pooling --------------------------------------------------------

def fit_isotonic(df: DataFrame, y: str, yhat: str):
    """Monotone map from prediction to outcome.

    Rows with equal predictions are merged into one weighted point first,
    which leaves the fit unchanged and shrinks what has to be sorted.
    """
    pts = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(yhat).agg(F.avg(y).alias("_y"), F.count(F.lit(1)).alias("_w"))
    return IsotonicRegression(featuresCol=yhat, labelCol="_y", weightCol="_w", predictionCol="calibrated", isotonic=True).fit(pts)


def apply_isotonic(df: DataFrame, model, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Calibrated prediction clamped to the target's range."""
    return model.transform(df).withColumn("calibrated", clip("calibrated", lo, hi))


def calibration_bins(df: DataFrame, y: str, yhat: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over ``[min, max + 1e-8]`` with mean prediction and outcome."""
    rng = df.agg(F.min(yhat).alias("_lo"), (F.max(yhat) + 1e-8).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(yhat) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return df.transform(attach_row, rng).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(yhat).alias("mean_pred"), F.avg(y).alias("mean_true")).withColumn(
        "abs_error", F.abs(F.col("mean_pred") - F.col("mean_true")))


def calibration_metrics(df: DataFrame, y: str, yhat: str, bins: int = 10) -> DataFrame:
    """ECE, MAE, calibration slope and intercept in one row."""
    ece = calibration_bins(df, y, yhat, bins).agg(ratio(F.sum(F.col("abs_error") * F.col("n")), F.sum("n")).alias("ece"))
    fit = df.agg(F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"), F.coalesce(F.regr_slope(y, yhat), F.lit(1.0)).alias("slope"),
                 F.coalesce(F.regr_intercept(y, yhat), F.lit(0.0)).alias("intercept"), F.count(F.lit(1)).alias("n_samples"))
    return fit.transform(attach_row, ece)


def pooling_adjustments(df: DataFrame, by: str, y: str, yhat: str, strength: float = 10.0) -> DataFrame:
    """Shrunken mean residual per type."""
    r = F.col(y) - F.col(yhat)
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(r).alias("mean_residual"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("adjustment", F.col("mean_residual") * F.col("n") / (F.col("n") + strength))


def apply_pooling(df: DataFrame, adj: DataFrame, by: str, yhat: str, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Prediction plus its type's adjustment; unseen types get none.

    The adjustments, one row per type, go to the rows: a join that deals the
    rows out by type would gather each of the few types in one task.
    """
    j = df.join(F.broadcast(adj.select(by, "adjustment")), by, "left")
    return j.withColumn("pooled", clip(F.col(yhat) + F.coalesce("adjustment", F.lit(0.0)), lo, hi))


def holdout_evaluation(df: DataFrame, features: Sequence[str], target: str, event: str = "date_id", *, n: int = P.HOLDOUT_EVENTS,
                       alpha: float = 1.0, draws: int = P.BOOTSTRAP_DRAWS) -> DataFrame:
    """Fit on all development events, score the holdout once, with event intervals."""
    parts = V.holdout(df.dropna(subset=[*features, target]), event, n)
    coef = fit_ridge(parts.where("not is_holdout"), features, target, alpha)
    scored = parts.where("is_holdout").transform(attach_row, coef).withColumn(
        "prediction", clip(linear_prediction(F.col("coef"), features), 0.0, 100.0))
    out = None
    for metric in ("mae", "rmse"):
        row = event_metric_interval(scored, target, "prediction", metric, event, draws=draws).select(
            F.lit(metric).alias("metric"), "point_estimate", "ci_lower", "ci_upper", "n_events", "n_samples")
        out = row if out is None else out.unionByName(row)
    return out
