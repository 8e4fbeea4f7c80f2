"""Encodings, binning and feature sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ledgerfold import presets as P
from ledgerfold.functions import bands as B, scalars as S
from ledgerfold.operators import ordered as O, returns as R, windows as W
from ledgerfold.operators.ordered import attach_row
from ledgerfold.session import discard, materialize


class LeakageError(ValueError):
    """A feature list names a column that describes the outcome."""


def leaky(names: Iterable[str], blocked: Iterable[str] = tuple(P.LEAKY_COLUMNS)) -> list[str]:
    """Names that match the blocklist, ignoring case and outer blanks."""
    bad = {b.strip().lower() for b in blocked}
    return [n for n in names if n.strip().lower() in bad]


def assert_no_leakage(names: Iterable[str], blocked: Iterable[str] = tuple(P.LEAKY_COLUMNS)) -> None:
    """Raise :class:`LeakageError` when a blocked column is used as a feature."""
    found = leaky(names, blocked)
    if found:
        raise LeakageError(f"blocked feature columns: {', '.join(sorted(found))}")


def fit_target_encoding(train: DataFrame, key: str, target: str, *, smoothing: float = 10, min_samples: int = 1) -> DataFrame:
    """Table (key, _te, _global) learnt from training rows only."""
    g = train.agg(F.avg(target).alias("_global"))
    n, m = F.col("_n"), F.col("_m")
    per = train.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(target).alias("_n"), F.avg(target).alias("_m"))
    value = F.when(n >= min_samples, (n * m + smoothing * F.col("_global")) / (n + smoothing)).otherwise(F.col("_global"))
    return per.transform(attach_row, g).select(key, value.alias("_te"), "_global")


def apply_target_encoding(df: DataFrame, enc: DataFrame, key: str, name: str) -> DataFrame:
    """Encoded value; the global mean for categories not seen in training."""
    g = enc.agg(F.max("_global").alias("_g"))
    return df.join(enc.select(key, "_te"), key, "left").transform(attach_row, g).withColumn(
        name, F.coalesce("_te", "_g")).drop("_te", "_g")


def frequency_encoding(df: DataFrame, key: str, name: str) -> DataFrame:
    """Share of each category among rows that have one."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_t"))
    table = per.transform(attach_row, total).select(key, (F.col("_n") / F.col("_t")).alias(name))
    return df.join(table, key, "left")


def quantile_bins(df: DataFrame, col: str, k: int, name: str) -> DataFrame:
    """Right-closed bins on exact quantile edges, equal edges merged.

    The edges are one row of k+1 numbers; the first bin includes the minimum.
    """
    points = {f"_q{i}": i / k for i in range(k + 1)}
    edges = O.percentiles(df, [], col, points)
    edges = edges.select(F.array_sort(F.array_distinct(F.array(*[F.col(p) for p in points]))).alias("_e"))
    below = F.size(F.filter("_e", lambda e: e < F.col(col)))
    return df.transform(attach_row, edges).withColumn(name, F.when(F.col(col).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("_e")


def contest_features(c: DataFrame) -> DataFrame:
    """Type, entry-limit flags, log sizes and size bucket of a contest."""
    return c.withColumns({
        "contest_type": R.archetype(taxonomy="features"),
        "is_mme": F.coalesce(F.col("multi_entry_max") > 1, F.lit(False)).cast("int"),
        "is_se": F.coalesce(F.col("multi_entry_max") == 1, F.lit(False)).cast("int"),
        "log_field_size": F.log1p("contest_size"), "log_entry_cost": F.log1p("entry_fee"),
        "size_bucket": B.apply_band("contest_size", P.CONTEST_SIZE),
    })


def price_quality(players: DataFrame, minimum: float = 0.8) -> DataFrame:
    """Per date: is the share of members with an opening price high enough?"""
    return players.groupBy("date_id").agg((B.rate(F.col("open_prob").isNotNull()) >= minimum).cast("int").alias("is_high_quality"))


FEATURES = ["salary", "salary_pct", "salary_rank_overall", "salary_tier", "card_section", "card_position", "ownership_lag1", "ownership_lag2",
            "ownership_roll3", "historical_avg_ownership", "days_since_last", "n_prior", "contest_size", "entry_cost", "log_field_size", "num_on_slate",
            "consensus_prob", "is_favorite"]


def ownership_features(players: DataFrame) -> DataFrame:
    """Leak-safe feature matrix per (member, contest), target last.

    History is computed on the (member, date) panel and joined back, so a row
    sees only earlier dates.  Prices are blanked on low-coverage dates.

    The card is numbered on the panel itself.  Ranks and sizes of a contest are
    joined by (contest, salary), one narrow row each, before they meet the rows.
    Each step is written, so what it shuffled is gone when the next one begins;
    the result does not read ``players`` again.
    """
    assert_no_leakage(FEATURES)
    panel = players.groupBy("player_id", "date_id").agg(F.avg("ownership").alias("own"), F.min("contest_date").alias("_ts"),
                                                        F.max("salary").alias("_sal"))
    w = W.timeline(["player_id"], "date_id")
    card = W.position_in_group(panel, ["date_id"], ["-_sal", "player_id"], name="card_position", labels=P.CARD_SECTIONS, default=P.CARD_DEFAULT,
                               label_name="card_section")
    hist = W.expanding(W.rolling(W.lags(card, ["own"], [1, 2], w), ["own"], [3], w), ["own"], w)
    hist = materialize(W.recency(hist, "_ts", w).select(
        "player_id", "date_id", F.col("own_lag1").alias("ownership_lag1"), F.col("own_lag2").alias("ownership_lag2"),
        F.col("own_roll3_mean").alias("ownership_roll3"), F.col("own_exp_mean").alias("historical_avg_ownership"),
        "days_since_last", F.col("n_prior").cast("int").alias("n_prior"), "card_section", "card_position"), "history")
    size = players.groupBy("contest_id").agg(F.count(F.lit(1)).alias("num_on_slate"))
    gate = F.col("is_high_quality") == 1
    ranks = O.ranks(players.select("contest_id", "salary"), ["contest_id"], "salary", name="salary_rank_overall", descending=True).distinct()
    slate = materialize(ranks.join(size, "contest_id"), "slate")
    rows = players.select("player_id", "contest_id", "date_id", "salary", "ownership", "close_prob", "contest_size", "entry_fee")
    base = materialize(O._join_by(rows, slate, ["contest_id", "salary"], "inner"), "ranked")
    discard(slate)
    quality = materialize(price_quality(players), "quality")  # one row a date: known to be small before the rows are dealt out
    out = base.join(hist, ["player_id", "date_id"]).join(quality, "date_id")
    return out.withColumns({
        "salary_pct": F.col("salary") / P.SALARY_CAP, "salary_tier": B.apply_band("salary", P.SALARY_TIER),
        "entry_cost": F.col("entry_fee"), "log_field_size": F.log1p("contest_size"), "consensus_prob": F.when(gate, F.col("close_prob")),
        "is_favorite": F.when(gate, (F.col("close_prob") > 0.5).cast("int")),
    }).select("player_id", "contest_id", "date_id", *FEATURES, F.col("ownership").alias("target"))
