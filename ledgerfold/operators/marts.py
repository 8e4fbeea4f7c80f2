"""Star-schema dimensions, facts and reporting views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerfold import presets as P
from ledgerfold.functions.scalars import date_from_id
from ledgerfold.operators import windows as W
from ledgerfold.operators.returns import archetype


def event_dim(contests: DataFrame, members: DataFrame) -> DataFrame:
    """One row per date with contest and member counts, each aggregated first."""
    c = contests.groupBy("date_id").agg(F.countDistinct("contest_id").alias("n_contests"))
    m = members.groupBy("date_id").agg(F.countDistinct("player_id").alias("n_members"))
    return c.join(m, "date_id", "left").withColumn("event_date", date_from_id("date_id"))


def contest_dim(contests: DataFrame) -> DataFrame:
    """Contests with type, the sentinel left out."""
    return contests.where(F.col("contest_id") != P.SENTINEL_CONTEST).withColumn("contest_type", archetype(taxonomy="mart"))


def entity_dim(canonical: DataFrame | None, members: DataFrame) -> DataFrame:
    """Entities from the canonical table, else from the base rows."""
    if canonical is not None:
        return canonical.select("canonical_id", "canonical_name", "weight_class")
    return members.groupBy(F.col("player_id").alias("canonical_id")).agg(
        F.min("full_name").alias("canonical_name"), F.lit(None).cast("string").alias("weight_class"))


SNAPSHOT = ("full_name", "salary", "ownership", "actual_points", "contest_size", "contest_id", "close_prob")


def snapshot_fact(members: DataFrame, sections: DataFrame, canonical: DataFrame, last: str = SNAPSHOT[-1]) -> DataFrame:
    """One row per (date, entity): the largest contest's row, smallest id on ties.

    Rows that still tie are told apart by the columns in the order of SNAPSHOT, so
    a leading part of them, up to ``last``, is the same with or without the others.
    """
    keys, order = ["date_id", "player_id"], ["-contest_size", "contest_id"]
    one = W.keep_first(members, keys, order, SNAPSHOT[:SNAPSHOT.index(last) + 1])
    names = canonical.groupBy("canonical_name").agg(F.min("canonical_id").alias("canonical_id"))
    s = F.col("salary")
    tier = F.when(s >= 10000, "$10K+").when(s >= 9000, "$9K-$10K").when(s >= 8000, "$8K-$9K").when(s >= 7000, "$7K-$8K").when(
        s >= 6000, "$6K-$7K").otherwise("Under $6K")
    # sections first: the rows still lie by (date, entity)
    return (one.join(sections, keys, "left").join(names, F.col("full_name") == F.col("canonical_name"), "left").drop("canonical_name")
            .withColumn("salary_tier", tier))


def with_canonical(fact: DataFrame, canonical: DataFrame, name: str) -> DataFrame:
    """Attach the canonical id by name."""
    names = canonical.groupBy(F.col("canonical_name").alias(name)).agg(F.min("canonical_id").alias("canonical_id"))
    return fact.join(names, name, "left")


def performance_view(snapshot: DataFrame, events: DataFrame, predictions: DataFrame, signals: DataFrame) -> DataFrame:
    """Snapshot with event date, predicted share and exposure gap."""
    return (snapshot.join(events.select("date_id", "event_date"), "date_id")
            .join(predictions.select("date_id", "player_id", "predicted"), ["date_id", "player_id"], "left")
            .join(signals.select("date_id", "brand", "delta"), ["date_id", "brand"], "left"))


def expert_summary_view(signals: DataFrame, events: DataFrame) -> DataFrame:
    """Exposure gap statistics per event."""
    s = signals.groupBy("date_id").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("delta").alias("avg_delta"),
                                       F.max("delta").alias("max_delta"), F.min("delta").alias("min_delta"), F.avg("confidence").alias("avg_confidence"))
    return s.join(events.select("date_id", "event_date"), "date_id")


def accuracy_view(snapshot: DataFrame, predictions: DataFrame) -> DataFrame:
    """Absolute error of the predicted share where the outcome is known."""
    return snapshot.where(F.col("ownership").isNotNull()).join(
        predictions.select("date_id", "player_id", "predicted"), ["date_id", "player_id"]).withColumn(
        "absolute_error", F.abs(F.col("ownership") - F.col("predicted")))


def register_views(views: dict[str, DataFrame]) -> None:
    """Make marts available to SQL as temporary views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
