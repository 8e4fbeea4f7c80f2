"""Connected components and other steps shared by the near-duplicate operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfold.session import materialize


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep the batches sent to Python small: they bound a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Smallest reachable node of every node of ``edges`` (a long, b long).

    Alternates large-star and small-star steps until nothing changes; the
    number of rounds grows with the logarithm of the longest path.  Every
    round is a partial aggregate and a join, both of which Spark can split
    when one node has very many neighbours, and is written out, so losing an
    executor costs one round.  Returns (node, component) for nodes with links.
    """
    current = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    mark = None
    while True:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        current = materialize(small, label)
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    tops = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        tops.select("node", F.col("node").alias("component")))


def extended(comp: DataFrame, links: DataFrame | None) -> DataFrame:
    """``comp`` (node, component) after more ``links`` (a, b).

    Only links between different groups matter.  They become edges between the
    groups' names, a far smaller graph whose components rename the groups.
    """
    if links is None:
        return comp
    ends = (links.join(comp.withColumnsRenamed({"node": "a", "component": "c_a"}), "a", "left")
            .join(comp.withColumnsRenamed({"node": "b", "component": "c_b"}), "b", "left")
            .select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b").distinct())
    ends = materialize(ends, "merged")
    if ends.isEmpty():
        return comp
    renamed = materialize(components(ends, "merged"), "renamed")
    # nodes without a group so far are named by themselves
    both = comp.select("node", "component").union(renamed.select("node", F.col("node").alias("component")).join(comp.select("node"), "node", "left_anti"))
    moved = both.join(renamed.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return materialize(moved.select("node", F.coalesce("to", "component").alias("component")), "groups")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name, k = f"_{base}", 0
    while name.lower() in taken:
        k += 1
        name = f"_{base}_{k}"
    return name


def local_groups(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Smallest node reachable by the links (a[i], b[j]) inside a block, for both sides."""
    left, right = a.copy(), b.copy()
    while True:
        before = (left.sum(), right.sum())
        np.minimum.at(right, j, left[i])
        np.minimum.at(left, i, right[j])
        if (left.sum(), right.sum()) == before:
            return left, right
