"""Correlated pairs, variance inflation and feature clusters."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def correlated_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Pairs with ``|r| > threshold`` (pairwise complete), strongest first.

    All coefficients come from one aggregate; the result has one row per pair.
    """
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"_{i}")
                   for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"_{i}").alias("r"))
                    for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(arr).alias("p")).select("p.*").where(F.abs("r") > threshold).orderBy(
        F.abs("r").desc(), "feature_1", "feature_2")


def gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """k x k matrix of sums of products of ``[1, cols...]`` over complete rows."""
    full = df.dropna(subset=list(cols)).withColumn("_one", F.lit(1.0))
    names = ["_one", *cols]
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = full.agg(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")) for i, j in cells]).first()
    g = np.zeros((len(names),) * 2)
    for v, (i, j) in zip(row, cells):
        g[i, j] = g[j, i] = v or 0.0
    return g


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation ``1/(1-R2)`` per column, infinite when exact.

    One distributed aggregate gives the k x k matrix; only that reaches the
    driver.
    """
    g = gram(df, cols)
    n, m = g[0, 0], g[0, 1:] / g[0, 0]
    c = g[1:, 1:] / n - np.outer(m, m)
    s = np.sqrt(np.diag(c))
    r = c / np.outer(s, s)
    out = []
    for i, name in enumerate(cols):
        rest = [j for j in range(len(cols)) if j != i]
        r2 = float(r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)]) @ r[rest, i]) if rest else 0.0
        out.append((name, float("inf") if 1 - r2 < 1e-10 else 1 / (1 - r2)))
    return df.sparkSession.createDataFrame(out, "feature string, vif double")


def clusters(pairs: DataFrame) -> DataFrame:
    """Single-linkage groups: connected components of the correlated pairs.

    ``pairs`` has at most k(k-1)/2 rows for k features, so it is joined on the
    driver side of the feature list, never on data rows.
    """
    edges = [(r["feature_1"], r["feature_2"]) for r in pairs.select("feature_1", "feature_2").collect()]
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = sorted((root(x), x) for x in parent)
    return pairs.sparkSession.createDataFrame(rows, "cluster string, feature string")
