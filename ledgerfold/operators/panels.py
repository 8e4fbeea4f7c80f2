"""Analysis panels: member rows of a date with price, value, outcome and class columns.

Rows come one per (date, member), taken from the date's largest contest.  Each
panel adds only expressions to those rows; the event median is the one step
that groups.  Bands outside of their edges and flags of a null value are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerfold import presets as P
from ledgerfold.functions.bands import apply_band, map_label
from ledgerfold.operators import ordered, prices, returns, windows


def one_per_event(df: DataFrame, keys: Sequence[str], *, size: str = "contest_size", contest: str = "contest_id") -> DataFrame:
    """One row per key: that of the largest contest, ties to the smaller contest id, then the smaller member."""
    ties = [c for c in ("player_id",) if c in df.columns and c not in keys]
    return windows.keep_first(df, keys, [f"-{size}", contest, *ties])


def salary_value(points: str = "actual_points", salary: str = "salary", empty: float | None = None) -> Column:
    """Points per thousand of salary; ``empty`` where there is no positive salary."""
    return F.when(F.col(salary) > 0, F.col(points) / (F.col(salary) / 1000)).otherwise(F.lit(empty).cast("double"))


def construction(df: DataFrame) -> DataFrame:
    """Bands of salary, ownership and closing price, direction of the move, value and its two thresholds."""
    value = salary_value()
    return df.where("close_prob IS NOT NULL AND actual_points IS NOT NULL").withColumns({
        "salary_tier": apply_band("salary", P.ENTITY_SALARY), "ownership_band": apply_band("ownership", P.ENTITY_OWN),
        "close_prob_band": apply_band("close_prob", P.CLOSE_PROB), "line_move_dir": prices.move_direction(missing="no_data"),
        "salary_value": value, "is_ceiling": value >= 8, "is_optimal_range": value >= 6})


def detailed(df: DataFrame, *, womens: Sequence[str] = P.WOMENS_CLASSES, other: Sequence[str] = ("Unknown", "Catch Weight")) -> DataFrame:
    """:func:`construction` with smash and dud flags, favourite, gender, class group and price tier."""
    c = F.col("weight_class")
    short = F.when(F.startswith(c, F.lit("Women's ")), F.regexp_replace(c, "^Women's ", "W-")).when(F.startswith(c, F.lit("W-")), c).otherwise(F.concat(F.lit("W-"), c))
    return construction(df).drop("is_optimal_range").withColumns({
        "is_smash": F.col("salary_value") >= 10, "is_dud": F.col("actual_points") < 10,
        "fav_dog": F.when(F.col("close_prob") > 0.5, "Favorite").otherwise("Underdog"),
        "gender": F.when(c.isin(*womens), "Women's").when(~c.isin(*other), "Men's").otherwise("Unknown"),
        "weight_group": F.when(c.isin(*womens), short).when(c.isin(*other), "Other").otherwise(c),
        "prob_tier": apply_band("close_prob", P.PROB_TIER)})


def archetype_members(df: DataFrame, *, tiers: Mapping[str, str] = P.WEIGHT_CLASS_TIERS, womens: Sequence[str] = P.WOMENS_CLASSES) -> DataFrame:
    """One row per (date, name) with contest archetype, value (0 without a salary), outcome flags, class tier and gender."""
    rows = one_per_event(df, ["date_id", "full_name"])
    value = salary_value(empty=0.0)
    return rows.withColumns({
        "archetype": returns.archetype(taxonomy="study"), "salary_value": value, "is_ceiling": F.coalesce(value >= 8, F.lit(False)),
        "is_dud": F.coalesce(F.col("actual_points") == 0, F.lit(False)), "tier": map_label("weight_class", tiers, "?"),
        "gender": F.when(F.col("weight_class").isin(*womens), "Women").otherwise("Men")})


def archetype_prices(df: DataFrame, *, tiers: Mapping[str, str] = P.WEIGHT_CLASS_TIERS, womens: Sequence[str] = P.WOMENS_CLASSES) -> DataFrame:
    """Priced rows with points: direction, price band, value, outcome flags, class tier and gender."""
    value = salary_value(empty=0.0)
    return df.where("actual_points IS NOT NULL").withColumns({
        "salary_value": value, "is_ceiling": value >= 8, "is_dud": F.col("actual_points") == 0, "line_move_dir": prices.move_direction(),
        "prob_band": apply_band("close_prob", P.PROB_BAND), "tier": map_label("weight_class", tiers, "?"),
        "gender": F.when(F.col("weight_class").isin(*womens), "Women").otherwise("Men")})


def composition_members(df: DataFrame, *, womens: Sequence[str] = P.WOMENS_CLASSES) -> DataFrame:
    """Price band, direction, size of a move towards the member, value, and duds measured against the event's median."""
    move = F.col("close_prob") - F.col("open_prob")
    value, points = salary_value(), F.col("actual_points")
    out = ordered.with_percentiles(df, ["date_id"], "actual_points", {"event_median": 0.5})
    return out.withColumns({
        "prob_band": apply_band("close_prob", P.PROB_BAND), "salary_value": value, "line_move_dir": prices.move_direction(),
        "steam_magnitude": F.when(move > 0.02, apply_band(F.greatest(move * 100, F.lit(2.0)), P.STEAMED)),
        "gender": F.when(F.col("weight_class").isin(*womens), "Women").otherwise("Men"), "ceiling_hit": F.coalesce(value >= 8, F.lit(False)),
        "is_dud": F.coalesce((points == 0) | (points < F.col("event_median") * 0.3), F.lit(False))})
