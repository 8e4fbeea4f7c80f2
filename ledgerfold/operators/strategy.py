"""Strategy returns, risk metrics, deflated Sharpe, trial log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from math import e

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerfold.functions.scalars import normal_cdf, normal_ppf
from ledgerfold.operators import windows as W
from ledgerfold.operators.returns import ratio

EULER_GAMMA = 0.5772156649015329


def strategy_return(actual: str, prediction: str | Column, size: str | Column = "size") -> Column:
    """``size * (actual - prediction) / (|prediction| + 1e-8)``."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    s = F.col(size) if isinstance(size, str) else size
    return s * (F.col(actual) - p) / (F.abs(p) + 1e-8)


def sharpe(ret: str, periods: int = 52, risk_free: float = 0.02) -> Column:
    """Annualised Sharpe ratio; zero for one row or a constant series."""
    sd = F.stddev_samp(ret)
    value = F.try_divide(F.avg(ret) * periods - risk_free, sd * F.sqrt(F.lit(float(periods))))
    return F.when((F.count(ret) < 2) | (sd == 0), 0.0).otherwise(value)


def risk_metrics(df: DataFrame, by: Sequence[str], ret: str) -> DataFrame:
    """Total, win rate, Sharpe, moments and profit factor per strategy."""
    r = F.col(ret)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum(r).alias("total_return"), F.avg((r > 0).cast("double")).alias("win_rate"),
        sharpe(ret).alias("sharpe"), F.avg(r).alias("mean_return"), F.stddev_pop(r).alias("std_return"),
        F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurtosis"),
        ratio(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"))


def drawdowns(df: DataFrame, by: Sequence[str], order: Sequence[str], ret: str) -> DataFrame:
    """Largest fall of the cumulative return below its running peak."""
    return W.equity_curve(df, by, order, ret).groupBy(*by).agg(F.max("drawdown").alias("max_drawdown"))


def _states(width: int):
    """Per range part and strategy: sum, highest and lowest running sum, largest fall."""
    def work(batches):
        total, high, low, fall, part, n = np.zeros(width), np.full(width, -np.inf), np.full(width, np.inf), np.zeros(width), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            run = total + np.asarray(batch.column(1).flatten()).reshape(-1, width).cumsum(0)
            peak = np.maximum(np.maximum.accumulate(run, 0), high)
            fall = np.maximum(fall, (peak - run).max(0))
            high, low, total, n = peak[-1], np.minimum(low, run.min(0)), run[-1], n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part] * width, pa.int32()), pa.array(np.arange(width, dtype=np.int32)),
                                              *[pa.array(x) for x in (total, high, low, fall)]], names=["part", "at", "total", "high", "low", "fall"])

    return work


def drawdowns_of(df: DataFrame, order: Sequence[str], returns: Sequence[Column]) -> DataFrame:
    """(at, max_drawdown) of every strategy of a list, from one ordering of the rows.

    Rows are range-sorted once with an array of returns.  A part becomes one
    small state per strategy; states merge from left to right, and there are as
    many as range parts.  A null return counts as 0.  ``order`` should be total.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*order, F.array(*[F.coalesce(r.cast("double"), F.lit(0.0)) for r in returns]).alias("r"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "r")
    states = ranged.mapInArrow(_states(len(returns)), "part int, at int, total double, high double, low double, fall double")
    before = Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = states.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    placed = placed.withColumn("peak", F.max(F.col("base") + F.col("high")).over(before))
    worst = F.greatest("fall", F.col("peak") - F.col("base") - F.col("low"))
    return placed.groupBy("at").agg(F.max(worst).alias("max_drawdown"))


def backtest_of(df: DataFrame, by: str, keys: Sequence, order: Sequence[str], returns: Sequence[Column]) -> DataFrame:
    """As :func:`backtest` for strategies whose returns are columns of one row: ``keys`` name them in the column ``by``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias(by), r.alias("r")) for k, r in zip(keys, returns)]))
    m = risk_metrics(df.select(each.alias("_s")).select("_s.*"), [by], "r")
    name = F.element_at(F.array(*map(F.lit, keys)), F.col("at") + 1).alias(by)
    return _with_calmar(m.join(drawdowns_of(df, order, returns).select(name, "max_drawdown"), by))


def backtest(df: DataFrame, by: Sequence[str], order: Sequence[str], ret: str) -> DataFrame:
    """Risk metrics with drawdown and Calmar ratio."""
    return _with_calmar(risk_metrics(df, by, ret).join(drawdowns(df, by, order, ret), list(by)))


def _with_calmar(m: DataFrame) -> DataFrame:
    return m.withColumn("calmar", F.when(F.col("max_drawdown") > 0, ratio(F.col("total_return"), F.col("max_drawdown"))).otherwise(0.0))


def expected_max_sharpe(trials: Column) -> Column:
    """Expected largest Sharpe among unskilled trials."""
    n = trials.cast("double")
    return (1 - EULER_GAMMA) * normal_ppf(1 - 1 / n) + EULER_GAMMA * normal_ppf(1 - 1 / (n * e))


def deflated_sharpe(s: str, trials: str | Column, skew: str | Column | None = None, kurt: str | Column | None = None,
                    variant: str = "divided") -> Column:
    """Probability that the Sharpe beats the best of ``trials`` unskilled ones.

    ``divided`` divides the variance by trials-1, ``undivided`` does not.
    """
    x, n = F.col(s), F.col(trials) if isinstance(trials, str) else trials
    pick = lambda c, default: F.lit(default) if c is None else F.col(c) if isinstance(c, str) else c
    sk, ku = pick(skew, 0.0), pick(kurt, 3.0)
    var = 1 + 0.5 * x * x - sk * x + (ku - 3) / 4 * x * x
    if variant == "divided":
        var = var / F.greatest(n - 1, F.lit(1))
    z = F.try_divide(x - expected_max_sharpe(n), F.sqrt(F.when(var > 0, var)))
    hit = F.when(x > 0, 1.0).otherwise(0.0)
    return F.when(n <= 1, hit).otherwise(F.coalesce(normal_cdf(z), F.when(x > expected_max_sharpe(n), 1.0).otherwise(0.0)))


def param_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of a parameter grid, in order."""
    return [dict(zip(grid, v)) for v in product(*grid.values())]


def with_trials(df: DataFrame, params: Sequence[dict], prediction) -> DataFrame:
    """Each row once per parameter set: a literal array on the row, no join.

    ``prediction(params_struct) -> Column`` gives the strategy's forecast.
    """
    structs = F.array(*[F.struct(F.lit(i + 1).alias("trial"), *[F.lit(v).alias(k) for k, v in p.items()]) for i, p in enumerate(params)])
    d = df.withColumn("_t", F.explode(structs))
    return d.withColumn("trial", F.col("_t.trial")).withColumn("prediction", prediction(F.col("_t")))


def rank_trials(metrics: DataFrame, *, final_count: bool = False, top: int | None = None) -> DataFrame:
    """Trials ranked by deflated Sharpe.

    By default trial i is deflated by i (trials logged so far); with
    ``final_count`` every trial is deflated by the total.  One row per trial.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) if final_count else F.col("trial")
    d = metrics.withColumn("n_trials", n).withColumn("deflated_sharpe", deflated_sharpe("sharpe", "n_trials"))
    d = d.orderBy(F.desc("deflated_sharpe"), "trial")
    return d.limit(top) if top else d


def trial_log(trials: DataFrame, params: Column) -> DataFrame:
    """Trial table with parameter hash and the best Sharpe so far."""
    w = Window.partitionBy(F.lit(1)).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)  # one row per trial
    return trials.withColumn("params_hash", F.substring(F.md5(F.to_json(params)), 1, 8)).withColumn(
        "best_so_far", F.max("sharpe").over(w)).withColumn("total_trials", F.count(F.lit(1)).over(w))
