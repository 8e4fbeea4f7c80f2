"""Model explanation over any ``predict(df) -> df with 'prediction'``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerfold import presets as P
from ledgerfold.functions.bands import rate
from ledgerfold.operators import inference as I, ordered as O
from ledgerfold.operators.models import auc
from ledgerfold.operators.ordered import attach_row
from ledgerfold.session import materialize

Predict = Callable[[DataFrame], DataFrame]


def column_model(expr) -> Predict:
    """Turn a column expression into a predict function."""
    return lambda df: df.withColumn("prediction", expr)


def score(df: DataFrame, y: str, metric: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(score): higher is better; rmse and mae are negated."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = F.col(y) - F.col("prediction")
    avg = lambda x: F.sum(x * w) / F.sum(w)
    if metric == "auc":
        return auc(df, y, "prediction", by).withColumnRenamed("auc", "score")
    expr = {"rmse": lambda: -F.sqrt(avg(e * e)), "mae": lambda: -avg(F.abs(e)),
            "r2": lambda: 1 - F.sum(w * e * e) / (F.sum(w * F.col(y) * F.col(y)) - F.pow(F.sum(w * F.col(y)), 2) / F.sum(w)),
            "accuracy": lambda: rate(F.col(y) == F.round("prediction"))}[metric]()
    return df.groupBy(*by).agg(expr.alias("score"))


# Neighbouring rows that are moved together.
BLOCK = 2048


def shuffled_copies(df: DataFrame, key: Sequence[str], cols: Sequence[str], seed: int, repeats: int, fold: str | None = None) -> DataFrame:
    """One copy of ``df`` per (``_f``, ``_rep``) with the column ``_f`` shuffled.

    Rows are numbered once, in the order of a hash of their key, so neighbours
    are unrelated.  A copy takes the column from the row a drawn number of
    places further on, around the end: a permutation for any number of rows.
    The drawn shift is never zero (but for a single row).  With an integer
    ``fold`` rows are numbered and shuffled within their fold, each fold under
    its own seed (``seed + fold``).

    Places move by blocks: a block of neighbours finds a copy's values in two
    or three others, so what is shuffled for a copy is its one column, and rows
    are multiplied only after the last join.
    """
    by = [fold] if fold else []
    salt = F.lit(seed) + F.col(fold) if fold else F.lit(seed)
    h = F.md5(F.concat_ws("|", salt.cast("string"), *[F.col(k).cast("string") for k in key]))
    at = O.running(df.withColumn("_h", h), by, ["_h", *key], number="_at").drop("_h").withColumn("_at", F.col("_at") - 1)
    held = F.struct("_at", F.struct(*df.columns).alias("r"))
    numbered = at.groupBy(*by, F.floor(F.col("_at") / BLOCK).alias("_b")).agg(F.sort_array(F.collect_list(held)).alias("_rows"))
    blocks = materialize(numbered.select(*by, "_b", F.col("_rows.r").alias("_rows")), "blocks")
    count = blocks.select(*by, "_b", F.size("_rows").alias("_m"))
    size = count.groupBy(*by).agg(F.sum("_m").alias("_n"))
    sized = count.join(size, fold) if fold else attach_row(count, size)
    many = sized.withColumn("_f", F.explode(F.array(*[F.lit(c) for c in cols]))).withColumn(
        "_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    shift = I.hash_uniform_int(F.greatest(F.col("_n") - 1, F.lit(1)), salt, F.col("_rep"), F.col("_f")) + 1
    # the places start ... end - 1, then, around the end, 0 ... over - 1
    many = many.withColumn("_start", (F.col("_b") * BLOCK + shift) % F.col("_n")).withColumn(
        "_end", F.least(F.col("_start") + F.col("_m"), F.col("_n"))).withColumns(
        {"_first": F.floor(F.col("_start") / BLOCK), "_last": F.floor((F.col("_end") - 1) / BLOCK),
         "_over": F.col("_start") + F.col("_m") - F.col("_end")})

    def piece(order, block, begin, length):
        return F.struct(F.lit(order).alias("o"), block.cast("long").alias("b"), begin.cast("int").alias("at"), length.cast("int").alias("n"))

    zero, border = F.lit(0), (F.col("_first") + 1) * BLOCK
    pieces = F.array(piece(0, F.col("_first"), F.col("_start") % BLOCK, F.least("_end", border) - F.col("_start")),
                     piece(1, F.col("_last"), zero, F.greatest(F.col("_end") - border, zero)), piece(2, zero, zero, F.col("_over")))
    moves = many.select(*by, "_b", "_f", "_rep", F.explode(F.filter(pieces, lambda x: x["n"] > 0)).alias("_x")).withColumn("_src", F.col("_x.b"))
    source = blocks.select(*by, F.col("_b").alias("_src"), *[F.col("_rows")[c].alias(f"_p_{c}") for c in cols])
    moved = moves.join(source, [*by, "_src"]).select(*by, "_b", "_f", "_rep", F.struct("_x.o", *[
        F.when(F.col("_f") == c, F.slice(f"_p_{c}", F.col("_x.at") + 1, F.col("_x.n"))).alias(c) for c in cols]).alias("_v"))
    whole = moved.repartition(*by, "_b").groupBy(*by, "_b", "_f", "_rep").agg(F.array_sort(F.collect_list("_v")).alias("_v"))
    values = whole.select(*by, "_b", "_f", "_rep", *[F.flatten(F.col("_v")[c]).alias(f"_p_{c}") for c in cols])
    rows = blocks.join(values, [*by, "_b"]).select("_f", "_rep", *[f"_p_{c}" for c in cols], F.posexplode("_rows").alias("_at", "_r"))
    taken = [F.when(F.col("_f") == c, F.col(f"_p_{c}")[F.col("_at")]).otherwise(F.col("_r")[c]).alias(c) if c in cols else F.col("_r")[c].alias(c)
             for c in df.columns]
    return rows.select(*taken, "_f", "_rep")


def permutation_importance(
    df: DataFrame, predict: Predict, key: Sequence[str], features: Sequence[str], y: str, *, metric: str = "mae", repeats: int = 10,
    weight: str | None = None, seed: int = P.SEED, fold: str | None = None,
) -> DataFrame:
    """(feature, importance, std): loss of score when a feature is shuffled.

    All copies are scored by a single aggregate.  With ``fold`` every fold is
    scored and shuffled on its own and the rows are (fold, feature, importance,
    std); ``predict`` sees the fold's columns, its coefficients for instance.
    """
    by = [fold] if fold else []
    base = score(predict(df), y, metric, weight, by).withColumnRenamed("score", "_base")
    runs = score(predict(shuffled_copies(df, key, features, seed, repeats, fold)), y, metric, weight, [*by, "_f", "_rep"])
    both = runs.join(base, fold) if fold else runs.transform(attach_row, base)
    d = F.col("_base") - F.col("score")
    return both.groupBy(*by, F.col("_f").alias("feature")).agg(F.avg(d).alias("importance"), F.stddev_pop(d).alias("std"))


def fold_importance(per_fold: DataFrame) -> DataFrame:
    """Stability of importances over folds: (feature, fold, importance) -> summary.

    The input has features x folds rows.
    """
    w = Window.partitionBy("fold")
    ties = F.count(F.lit(1)).over(Window.partitionBy("fold", "importance"))
    r = per_fold.withColumn("_rank", F.rank().over(w.orderBy(F.desc("importance"))) + (ties - 1) / 2).withColumn("_k", F.count(F.lit(1)).over(w))
    return r.groupBy("feature").agg(
        F.avg("importance").alias("mean_importance"), F.stddev_samp("importance").alias("std_importance"),
        F.avg("_rank").alias("mean_rank"), F.stddev_samp("_rank").alias("std_rank"),
        (1 - F.stddev_samp("_rank") / F.max("_k")).alias("rank_stability"))


def _grid(lo, hi, n: int):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))


def _counted(df: DataFrame, replaced: Sequence[str] = ()) -> DataFrame:
    """Rows that agree in all columns but the ``replaced`` ones, once, with their number ``_times``.

    A model predicts them alike, so a mean takes one prediction that many times.
    Without repeats this is one row per row; either way the rows are dealt out
    evenly, as every one of them meets a whole grid.
    """
    cols = [c for c in df.columns if c not in replaced]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_times"))
    if not cols:
        return counted.where("_times > 0")
    # by a hash of them: by the columns themselves it would be left out, and few rows put into few tasks
    return counted.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*cols))


def _point_sums(rows: DataFrame, predict: Predict) -> DataFrame:
    """(_k, _s, _m): sum and number of the predictions at every grid point ``_k``, a plain number and so a cheap key."""
    p = F.col("prediction")
    return predict(rows).groupBy("_k").agg(F.sum(p * F.col("_times")).alias("_s"), F.sum(F.when(p.isNotNull(), F.col("_times"))).alias("_m"))


def partial_dependence(df: DataFrame, predict: Predict, feature: str, *, grid: int = 20, limits: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(grid_value, mean prediction).  Rows meet the grid on the map side and are
    averaged there: the shuffle carries partitions x grid rows."""
    ends = O.percentiles(df, [], feature, {"_lo": limits[0], "_hi": limits[1]})  # one row
    line = ends.select(_grid(F.col("_lo"), F.col("_hi"), grid).alias("_line"))
    spread = _counted(df, [feature]).transform(attach_row, line).select("*", F.posexplode("_line").alias("_k", feature)).drop("_line")
    sums = _point_sums(spread, predict).transform(attach_row, line).withColumn("grid_value", F.col("_line")[F.col("_k")])
    return sums.groupBy("grid_value").agg((F.sum("_s") / F.sum("_m")).alias("pd"))  # equal ends: one point


def partial_dependence_2d(df: DataFrame, predict: Predict, f1: str, f2: str, *, grid: int = 10) -> DataFrame:
    """(v1, v2, mean prediction) on a min-max grid."""
    ends = df.agg(*[fn(f).cast("double").alias(f"_{n}{i}") for i, f in enumerate((f1, f2)) for n, fn in (("lo", F.min), ("hi", F.max))])
    lines = ends.select(*[_grid(F.col(f"_lo{i}"), F.col(f"_hi{i}"), grid).alias(f"_line{i}") for i in (0, 1)])
    v1, v2 = F.col("_line0")[F.floor(F.col("_k") / grid).cast("int")], F.col("_line1")[F.col("_k") % grid]
    spread = _counted(df, [f1, f2]).transform(attach_row, lines).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))))
    sums = _point_sums(spread.withColumns({f1: v1, f2: v2}).drop("_line0", "_line1"), predict)
    return sums.transform(attach_row, lines).groupBy(v1.alias("v1"), v2.alias("v2")).agg((F.sum("_s") / F.sum("_m")).alias("pd"))


def ale(df: DataFrame, predict: Predict, feature: str, bins: int = 10) -> DataFrame:
    """(bin, center, ale): accumulated local effects on exact quantile edges."""
    points = {f"_q{i}": i / bins for i in range(bins + 1)}
    e = O.percentiles(df, [], feature, points).select(F.array_sort(F.array_distinct(F.array(*[F.col(p) for p in points]))).alias("_e"))
    x = F.col(feature)
    at = F.least(F.greatest(F.size(F.filter("_e", lambda v: v <= x)) - 1, F.lit(0)), F.size("_e") - 2)
    d = df.transform(attach_row, e).withColumn("bin", at).withColumn("_a", F.col("_e")[F.col("bin")]).withColumn("_b", F.col("_e")[F.col("bin") + 1])
    both = d.withColumn("_side", F.explode(F.array(F.lit("lo"), F.lit("hi")))).withColumn(
        feature, F.when(F.col("_side") == "lo", F.col("_a")).otherwise(F.col("_b")))
    sign = F.when(F.col("_side") == "hi", F.col("prediction")).otherwise(-F.col("prediction"))
    local = predict(both).groupBy("bin", "_a", "_b").agg((F.sum(sign) / (F.count(F.lit(1)) / 2)).alias("_d"))
    w = Window.partitionBy(F.lit(1))  # one row per bin
    out = local.withColumn("_c", F.sum("_d").over(w.orderBy("bin")))
    return out.select("bin", ((F.col("_a") + F.col("_b")) / 2).alias("center"), (F.col("_c") - F.avg("_c").over(w)).alias("ale"))


def _cells(ends: DataFrame, features: Sequence[str], grid: int) -> DataFrame:
    """One row with the array ``_cells`` of (a, b, i, j, x, y): every point of all one-way
    grids (``b`` is -1) and all two-way grids, numbered by feature and grid step.

    The array grows with the features and the grid, never with the rows.
    """
    one = ends.agg(*[F.max(F.when(F.col("_f") == f, F.struct("_lo", "_hi", "_min", "_max"))).alias(f"_e{n}") for n, f in enumerate(features)])
    step = F.sequence(F.lit(0), F.lit(grid - 1))

    def point(n, i, lo, hi):
        low, high = F.col(f"_e{n}")[lo], F.col(f"_e{n}")[hi]
        return low + (high - low) * i / (grid - 1)

    def line(a):
        return F.transform(step, lambda i: F.struct(
            F.lit(a).alias("a"), F.lit(-1).alias("b"), i.alias("i"), F.lit(0).alias("j"),
            point(a, i, "_lo", "_hi").alias("x"), F.lit(None).cast("double").alias("y")))

    def plane(a, b):
        return F.flatten(F.transform(step, lambda i: F.transform(step, lambda j: F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), i.alias("i"), j.alias("j"),
            point(a, i, "_min", "_max").alias("x"), point(b, j, "_min", "_max").alias("y")))))

    k = range(len(features))
    return one.select(F.concat(*[line(a) for a in k], *[plane(a, b) for a, b in combinations(k, 2)]).alias("_cells"))


def interactions(df: DataFrame, predict: Predict, features: Sequence[str], *, grid: int = 20, top: int = 10) -> DataFrame:
    """Simplified H statistic per feature pair, all rows used, strongest first.

    One ordering gives the ends of all grids and one scan fills all of them:
    a row, equal ones together, meets every grid point on the map side and is
    averaged there, so the shuffle carries (tasks x points) rows however many
    features there are.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).cast("double").alias("_v")) for f in features])).alias("_x")).select("_x.*")
    ends = O.percentiles(long, ["_f"], "_v", {"_lo": 0.05, "_hi": 0.95, "_min": 0.0, "_max": 1.0})
    at = _counted(df).transform(attach_row, _cells(ends, features, grid)).select("*", F.posexplode("_cells").alias("_k", "_c")).drop("_cells")
    put = {f: F.when(F.col("_c.a") == n, F.col("_c.x")).when(F.col("_c.b") == n, F.col("_c.y")).otherwise(F.col(f).cast("double"))
           for n, f in enumerate(features)}
    sums = _point_sums(at.withColumns(put).drop("_c"), predict)
    means = sums.transform(attach_row, _cells(ends, features, grid)).withColumn("_c", F.col("_cells")[F.col("_k")]).select(
        "_c", (F.col("_s") / F.col("_m")).alias("_pd"))
    var = means.groupBy(F.col("_c.a").alias("_a"), F.col("_c.b").alias("_b")).agg(F.var_pop("_pd").alias("_v"))  # one row per pair and feature
    alone = var.where("_b = -1")
    pairs = var.where("_b >= 0").join(alone.select("_a", F.col("_v").alias("_va")), "_a").join(
        alone.select(F.col("_a").alias("_b"), F.col("_v").alias("_vb")), "_b")
    name = F.array(*[F.lit(f) for f in features])
    h = F.greatest(F.lit(0.0), F.try_divide(F.col("_v") - F.col("_va") - F.col("_vb"), F.col("_v")))
    return pairs.select(name[F.col("_a")].alias("feature1"), name[F.col("_b")].alias("feature2"),
                        F.coalesce(h, F.lit(0.0)).alias("h")).orderBy(F.desc("h"), "feature1", "feature2").limit(top)


def linear_attribution(df: DataFrame, coefs: Mapping[str, float]) -> DataFrame:
    """``coef * (x - mean)`` per feature; exact for linear models."""
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in coefs])
    return df.transform(attach_row, means).withColumns({f"attr_{f}": F.lit(float(c)) * (F.col(f) - F.col(f"_m_{f}")) for f, c in coefs.items()}).drop(
        *[f"_m_{f}" for f in coefs])


def global_attribution(attributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per feature."""
    one = attributed.agg(*[F.avg(F.abs(f"attr_{f}")).alias(f) for f in features])
    return one.unpivot([], list(features), "feature", "mean_abs")


def leakage_keywords(importance: DataFrame, words: Sequence[str], top: int = 10, feature: str = "feature") -> DataFrame:
    """Top features whose name contains an outcome keyword."""
    best = importance.orderBy(F.desc("importance"), feature).limit(top)
    return best.where(F.lower(feature).rlike("|".join(words)))
