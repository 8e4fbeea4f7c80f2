"""Merged drawdown states against a plain pass over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import strategy as S


def expected(r):
    run = np.cumsum(r)
    return float((np.maximum.accumulate(run) - run).max())


@pytest.mark.parametrize("n,parts", [(1, 4), (3, 8), (997, 7), (4000, 3)])
def test_states_merge_to_the_whole(spark, n, parts):
    rng = np.random.default_rng(n)
    a, b = rng.normal(0.01, 1, n).round(3), -np.abs(rng.normal(size=n)).round(3)
    rows = [(i % 13, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "d int, i int, a double, b double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["at"]: r["max_drawdown"] for r in S.drawdowns_of(df, ["d", "i"], [F.col("a"), F.col("b"), F.lit(1.0)]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows)
    assert np.allclose([got[0], got[1], got[2]], [expected([r[2] for r in order]), expected([r[3] for r in order]), 0.0])


def test_columns_and_rows_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0.05, 1, (300, 2)))]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    wide = S.backtest_of(df, "s", ["a", "b"], ["i"], [F.col("a"), F.col("b")]).orderBy("s").toPandas()
    long = df.selectExpr("i", "stack(2, 'a', a, 'b', b) as (s, r)")
    tall = S.backtest(long, ["s"], ["i"], "r").orderBy("s").toPandas()
    for c in tall.columns[1:]:
        assert np.allclose(tall[c].astype(float), wide[c].astype(float)), c
    none = S.drawdowns_of(df.where("i < 0"), ["i"], [F.col("a")])
    assert none.count() == 0
