"""Point-in-time features: lag, rolling, expanding, difference, recency.

The default grain is one row per (entity, date): rows are first averaged per
date, which stops one date leaking into itself and bounds every window
partition by the number of dates however hot the entity.  ``row_*`` operators
keep the row grain and use the distributed row number instead of a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from ledgerfold.operators import ordered


def collapse(df: DataFrame, entity: Sequence[str], date: str, values: Mapping[str, str]) -> DataFrame:
    """One row per (entity, date): ``{column: "avg" | "sum" | "max" | ...}``."""
    return df.groupBy(*entity, date).agg(*[getattr(F, how)(c).alias(c) for c, how in values.items()])


def timeline(entity: Sequence[str], date: str) -> WindowSpec:
    """Window over a collapsed panel: at most one row per date and entity."""
    return Window.partitionBy(*entity).orderBy(date)


def lags(df: DataFrame, cols: Sequence[str], ks: Sequence[int], w: WindowSpec, fill: float | None = None) -> DataFrame:
    """``<col>_lag<k>`` for each column and step."""
    def one(c: str, k: int) -> Column:
        x = F.lag(c, k).over(w)
        return x if fill is None else F.coalesce(x, F.lit(fill))
    return df.withColumns({f"{c}_lag{k}": one(c, k) for c in cols for k in ks})


_FRAME_AGGS = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def _framed(df: DataFrame, cols, aggs, frame: WindowSpec, suffix: str, min_periods: int) -> DataFrame:
    new = {}
    for c in cols:
        for a in aggs:
            new[f"{c}_{suffix}_{a}"] = F.when(F.count(c).over(frame) >= min_periods, _FRAME_AGGS[a](c).over(frame))
    return df.withColumns(new)


def rolling(df: DataFrame, cols: Sequence[str], sizes: Sequence[int], w: WindowSpec, *, aggs=("mean",),
            min_periods: int = 1) -> DataFrame:
    """``<col>_roll<w>_<agg>`` over the previous ``w`` rows, current excluded."""
    for size in sizes:
        df = _framed(df, cols, aggs, w.rowsBetween(-size, -1), f"roll{size}", min_periods)
    return df


def expanding(df: DataFrame, cols: Sequence[str], w: WindowSpec, *, aggs=("mean",), min_periods: int = 1) -> DataFrame:
    """``<col>_exp_<agg>`` over all earlier rows, current excluded."""
    return _framed(df, cols, aggs, w.rowsBetween(Window.unboundedPreceding, -1), "exp", min_periods)


def diffs(df: DataFrame, cols: Sequence[str], ks: Sequence[int], w: WindowSpec) -> DataFrame:
    """``<col>_diff<k>``: change against k rows earlier."""
    return df.withColumns({f"{c}_diff{k}": F.col(c) - F.lag(c, k).over(w) for c in cols for k in ks})


def pct_changes(df: DataFrame, cols: Sequence[str], ks: Sequence[int], w: WindowSpec) -> DataFrame:
    """``<col>_pct<k>``: relative change, NULL where the base is zero."""
    return df.withColumns({
        f"{c}_pct{k}": F.try_divide(F.col(c) - F.lag(c, k).over(w), F.lag(c, k).over(w)) for c in cols for k in ks})


def recency(df: DataFrame, ts: str, w: WindowSpec) -> DataFrame:
    """Whole days since the previous appearance and number of earlier ones."""
    gap = (F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.lag(ts).over(w))) / 86400
    return df.withColumn("days_since_last", F.floor(gap)).withColumn("n_prior", F.row_number().over(w) - 1)


def row_lags(df: DataFrame, entity: Sequence[str], order: Sequence[str], col: str, ks: Sequence[int]) -> DataFrame:
    """Lags at row grain without a window over the entity.

    Rows get their distributed position; lag k is an equi join on (entity,
    position - k), which spreads a hot entity over all tasks.
    """
    num = ordered.running(df, entity, order, number="_rn")
    for k in ks:
        prev = num.select(*entity, (F.col("_rn") + k).alias("_rn"), F.col(col).alias(f"{col}_lag{k}"))
        df_k = prev if k == ks[0] else df_k.join(prev, [*entity, "_rn"], "full")
    return num.join(df_k, [*entity, "_rn"], "left").drop("_rn")


def row_expanding_mean(df: DataFrame, entity: Sequence[str], order: Sequence[str], col: str) -> DataFrame:
    """Mean of all earlier rows at row grain, from distributed running sums."""
    run = ordered.running(df, entity, order, sums={
        "_s": F.coalesce(F.col(col), F.lit(0.0)), "_n": F.col(col).isNotNull().cast("long")})
    prior_n = F.col("_n") - F.col(col).isNotNull().cast("long")
    mean = F.try_divide(F.col("_s") - F.coalesce(F.col(col), F.lit(0.0)), prior_n)
    return run.withColumn(f"{col}_exp_mean", mean).drop("_s", "_n")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], rest: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first along ``order`` (``"-x"`` descending), then along ``rest``, all other columns unless named.

    A min over structs, so partial aggregation drops losers before the shuffle.
    Descending parts must be numeric.
    """
    rank = [(-F.col(o[1:])).alias(f"_o{i}") if o.startswith("-") else F.col(o).alias(f"_o{i}")
            for i, o in enumerate(order)]
    rest = [c for c in df.columns if c not in keys] if rest is None else list(rest)
    best = df.groupBy(*keys).agg(F.min(F.struct(*rank, F.struct(*rest).alias("_row"))).alias("_m"))
    return best.select(*keys, "_m._row.*")


def group_zscore(df: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """Population z-score; group moments are aggregated, then joined back."""
    m = df.groupBy(*by).agg(F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd"))
    return ordered._join_by(df, m, by, "left").withColumn(
        name, F.try_divide(F.col(col) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")


def distinct_per_group(df: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """Number of distinct values in the group, on every row."""
    n = df.groupBy(*by).agg(F.countDistinct(col).alias(name))
    return ordered._join_by(df, n, by, "left")


def share_within(df: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """``col`` as percent of its group total (total floored at 1)."""
    tot = df.groupBy(*by).agg(F.sum(col).alias("_t"))
    return ordered._join_by(df, tot, by, "left").withColumn(
        name, F.col(col) / F.greatest(F.col("_t"), F.lit(1)) * 100).drop("_t")


def position_in_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str], *, name: str = "position",
    labels: Mapping[int, str] | None = None, default: str = "prelim", label_name: str = "section",
) -> DataFrame:
    """Position along ``order`` within the group, with an optional label map."""
    out = ordered.running(df, by, order, number=name)
    if labels:
        chain = None
        for k, v in labels.items():
            hit = F.col(name) == k
            chain = F.when(hit, v) if chain is None else chain.when(hit, v)
        out = out.withColumn(label_name, chain.otherwise(default))
    return out


def equity_curve(df: DataFrame, by: Sequence[str], order: Sequence[str], pnl: str) -> DataFrame:
    """Cumulative return, running peak and drawdown, for any number of rows.

    One range partitioning serves both: a partition's peak is its local peak
    lifted by the return carried in, or the highest peak before it.
    """
    parts = ordered.range_parts(df, by, order)
    local = Window.partitionBy(ordered.PART, *by).orderBy(*ordered.sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    inner = parts.withColumn("_eq", F.sum(pnl).over(local)).withColumn("_pk", F.max("_eq").over(local))
    totals = inner.groupBy(ordered.PART, *by).agg(F.sum(pnl).alias("_t"), F.max("_pk").alias("_m"))
    before = Window.partitionBy(*by).orderBy(ordered.PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_cs", F.sum("_t").over(before))
    carry = carry.withColumn("_cp", F.max(F.col("_m") + F.coalesce("_cs", F.lit(0.0))).over(before))
    carry = carry.where("_cs IS NOT NULL").select(ordered.PART, *by, "_cs", "_cp")
    return ordered.with_carry(inner, carry, by).withColumns({
        "equity": F.col("_eq") + F.coalesce("_cs", F.lit(0.0)),
        "peak": F.greatest(F.col("_pk") + F.coalesce("_cs", F.lit(0.0)), F.col("_cp")),
    }).withColumn("drawdown", F.col("peak") - F.col("equity")).select(*df.columns, "equity", "peak", "drawdown")


# --- fractional differencing ----------------------------------------------

def ffd_weights(d: float, threshold: float = 1e-5) -> list[float]:
    """Weights w_0.. of (1-L)^d; the first one below the threshold is kept."""
    w = [1.0]
    while True:
        k = len(w)
        w.append(-w[-1] * (d - k + 1) / k)
        if abs(w[-1]) < threshold:
            break
    return w


def frac_diff(df: DataFrame, col: str, w: WindowSpec, d: float, threshold: float = 1e-5, name: str | None = None) -> DataFrame:
    """Fixed-window fractional difference; NULL until the window is full."""
    weights = ffd_weights(d, threshold)
    m = len(weights)
    frame = w.rowsBetween(-(m - 1), 0)
    xs = F.collect_list(col).over(frame)  # oldest first, at most m values
    ws = F.array(*[F.lit(x) for x in reversed(weights)])
    dot = F.aggregate(F.zip_with(xs, ws, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn(name or f"{col}_fd", F.when(F.size(xs) == m, dot))


def adf_t(df: DataFrame, entity: Sequence[str], date: str, col: str) -> DataFrame:
    """t statistic of the unit-root regression with a constant and one lag.

    Two-regressor least squares from centred sums, so one aggregate per series.
    """
    w = timeline(entity, date)
    d = df.where(F.col(col).isNotNull()).withColumn("_x1", F.lag(col).over(w)).withColumn("_z", F.col(col) - F.lag(col).over(w))
    d = d.withColumn("_x2", F.lag("_z").over(w)).where(F.col("_x2").isNotNull())
    s = lambda a, b: F.covar_pop(a, b) * F.count(F.lit(1))
    g = d.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("n"), s("_x1", "_x1").alias("s11"), s("_x2", "_x2").alias("s22"),
        s("_x1", "_x2").alias("s12"), s("_x1", "_z").alias("s1z"), s("_x2", "_z").alias("s2z"), s("_z", "_z").alias("szz"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    g = g.withColumn("det", det)
    b1 = F.try_divide(F.col("s1z") * F.col("s22") - F.col("s2z") * F.col("s12"), F.col("det"))
    b2 = F.try_divide(F.col("s2z") * F.col("s11") - F.col("s1z") * F.col("s12"), F.col("det"))
    g = g.withColumn("b1", b1).withColumn("b2", b2)
    s2 = F.try_divide(F.col("szz") - F.col("b1") * F.col("s1z") - F.col("b2") * F.col("s2z"), F.col("n") - 3)
    se = F.sqrt(F.when(s2 > 0, s2) * F.try_divide(F.col("s22"), F.col("det")))
    return g.where("n > 3").select(*entity, "n", F.try_divide(F.col("b1"), se).alias("t"))


def min_stationary_order(
    df: DataFrame, entity: Sequence[str], date: str, col: str, grid: Sequence[float], *, threshold: float = 1e-5,
    critical: float = -2.86, min_length: int = 10,
) -> DataFrame:
    """Smallest differencing order of the grid whose unit-root t is below critical.

    A differenced series of fewer than ``min_length`` values is not tested; 1.0
    stands where no order passes.
    """
    w = timeline(entity, date)
    wide = df
    for i, d in enumerate(grid):
        wide = frac_diff(wide, col, w, d, threshold, f"_d{i}")
    pairs = F.array(*[F.struct(F.lit(float(d)).alias("_order"), F.col(f"_d{i}").alias("_x")) for i, d in enumerate(grid)])
    long = wide.select(*entity, date, F.explode(pairs).alias("_p")).select(*entity, date, "_p._order", "_p._x")
    # the regression loses two values to its lags
    t = adf_t(long, [*entity, "_order"], date, "_x").where(F.col("n") >= min_length - 2)
    found = t.groupBy(*entity).agg(F.min(F.when(F.col("t") < critical, F.col("_order"))).alias("_d"), F.count(F.lit(1)).alias("_n"))
    return df.select(*entity).distinct().join(found, list(entity), "left").select(
        *entity, F.coalesce("_d", F.lit(1.0)).alias("min_d"), F.coalesce("_n", F.lit(0)).alias("n_orders_tested"))
