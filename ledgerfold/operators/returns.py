"""Weighted returns: regime columns, ROI tables, cross-tabs, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerfold import presets as P
from ledgerfold.functions.bands import apply_band, first_rule, rate, regex_family
from ledgerfold.operators import ordered


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is zero or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


# --- regime columns -------------------------------------------------------

def archetype(cap: str = "multi_entry_max", taxonomy: str = "discovery", size: str = "contest_size") -> Column:
    """Contest archetype from the entry cap (and size), by one of four rule sets."""
    c = F.col(cap)
    if taxonomy == "discovery":
        return first_rule([(c.isNull(), "UNLIMITED"), (c == 1, "SE"), (c <= 20, "LIMITED"), (c <= 150, "150-Max")],
                          "UNLIMITED")
    if taxonomy == "study":
        return first_rule([(c == 1, "SE"), (c.between(3, 18), "LIMITED"), (c == 20, "20-Max"), (c == 150, "150-Max")],
                          "UNLIMITED")
    if taxonomy == "features":
        return first_rule([(c > 1, "MME"), (F.col(size) <= 20, "SE")], "limited")
    if taxonomy == "mart":
        return first_rule([(c == 1, "Single Entry"), (c == 3, "3-Max"), (c == 20, "20-Max"), (c == 150, "150-Max"),
                           (c.between(2, 19), "Limited")], "MME")
    raise ValueError(f"unknown taxonomy {taxonomy}")


def _regimes() -> dict[str, tuple[list[str], Column]]:
    """New column -> (required inputs, expression)."""
    return {
        "slate_size": (["fight_count"], apply_band("fight_count", P.SLATE_SIZE)),
        "field_size": (["contest_size"], apply_band("contest_size", P.FIELD_SIZE)),
        "fee_tier": (["entry_fee"], apply_band("entry_fee", P.FEE_TIER)),
        "fight_count_band": (["fight_count"], apply_band("fight_count", P.FIGHT_COUNT)),
        "contest_archetype": (["multi_entry_max"], archetype()),
        "contest_family": (["contest_name"], regex_family("contest_name", P.FAMILIES)),
        "total_own_band": (["total_ownership"], apply_band("total_ownership", P.TOTAL_OWN)),
        "salary_remaining_band": (["total_salary"],
                                  apply_band(F.lit(P.SALARY_CAP) - F.col("total_salary"), P.SALARY_REMAINING)),
        "fav_count_band": (["favorite_count"], apply_band("favorite_count", P.FAV_COUNT)),
        "prob_sum_band": (["implied_prob_sum"], apply_band("implied_prob_sum", P.PROB_SUM)),
        "own_prob_band": (["own_prob_ratio"], apply_band("own_prob_ratio", P.OWN_PROB)),
        "dupe_band": (["lineup_count"], apply_band("lineup_count", P.DUPLICATION)),
        "min_own_band": (["min_ownership"], apply_band("min_ownership", P.MIN_OWN)),
        "max_own_band": (["max_ownership"], apply_band("max_ownership", P.MAX_OWN)),
        "tossup_label": (["tossup_count"], F.col("tossup_count").cast("int").cast("string")),
    }


def add_regime_columns(df: DataFrame) -> DataFrame:
    """Add every regime column whose inputs are present."""
    have = set(df.columns)
    return df.withColumns({k: e for k, (need, e) in _regimes().items() if have.issuperset(need)})


# --- ROI tables -----------------------------------------------------------

def roi_aggs(payout="payout", cost="cost", weight="user_count", percentile="lineup_percentile") -> list[Column]:
    """Rows, entries, weighted ROI, top-1% rate and cash rate of a group."""
    p, c, w = F.col(payout), F.col(cost), F.col(weight)
    return [
        F.count(F.lit(1)).alias("n_lineups"),
        F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n_entries"),
        F.round(ratio(F.sum(p * w), F.sum(c * w)), 4).alias("weighted_roi"),
        F.round(rate(F.col(percentile) <= 1), 4).alias("top1pct_rate"),
        F.round(rate(p > 0), 4).alias("cash_rate"),
    ]


def weighted_roi(df: DataFrame, by: Sequence[str] = (), payout="payout", cost="cost", weight="user_count") -> DataFrame:
    """``sum(payout*w) / sum(cost*w)`` per group, NULL when the cost is zero."""
    return df.groupBy(*by).agg(
        ratio(F.sum(F.col(payout) * F.col(weight)), F.sum(F.col(cost) * F.col(weight))).alias("weighted_roi"))


def roi_table(df: DataFrame, by: Sequence[str], **cols: str) -> DataFrame:
    """ROI metrics per bucket; rows without a bucket are left out."""
    for b in by:
        df = df.where(F.col(b).isNotNull())
    return df.groupBy(*by).agg(*roi_aggs(**cols))


def gender(weight_class: str = "weight_class", womens: Sequence[str] = P.WOMENS_CLASSES) -> Column:
    """``Women's`` or ``Men's`` by weight class; NULL where the class is not known."""
    c = F.col(weight_class)
    return F.when(c.isin(*womens), "Women's").when(~c.isin("Unknown", "Catch Weight"), "Men's")


def unpivot_keys(df: DataFrame, dims: Mapping[str, Sequence[str]], keep: Sequence[str], name: str = "analysis") -> DataFrame:
    """Each row once per analysis, with that analysis' key columns as ``k0, k1, ...``.

    Only small integers are exploded; names and keys are picked by CASE, so the
    copies carry no arrays or structs and the following aggregate has a narrow
    key.  Copies are combined before the shuffle, which then holds buckets, not
    rows.  Rows without a bucket in an analysis are left out of it.
    """
    width = max(len(ks) for ks in dims.values())
    columns = list(dict.fromkeys(k for ks in dims.values() for k in ks))
    copies = df.select(*dict.fromkeys([*keep, *columns]), F.explode(F.array(*[F.lit(i) for i in range(len(dims))])).alias("_a"))
    a, picks, lacking = F.col("_a"), [], F.lit(False)
    for pos in range(width):
        chain, has = None, []
        for c in columns:
            ids = [i for i, ks in enumerate(dims.values()) if len(ks) > pos and ks[pos] == c]
            if ids:
                has += ids
                value = F.col(c).cast("string")
                chain = F.when(a.isin(ids), value) if chain is None else chain.when(a.isin(ids), value)
        picks.append(chain.alias(f"k{pos}"))
        lacking = lacking | (a.isin(has) & F.col(f"k{pos}").isNull())
    label = None
    for i, n in enumerate(dims):
        label = F.when(a == i, F.lit(n)) if label is None else label.when(a == i, F.lit(n))
    return copies.select(*keep, "_a", label.alias(name), *picks).where(~lacking).drop("_a")


def roi_tables(df: DataFrame, dims: Mapping[str, Sequence[str]], **cols: str) -> DataFrame:
    """Many ROI tables from one scan: ``{analysis: [key, ...]}`` -> long table.

    Buckets of a multi-key analysis are joined with `` / ``.
    """
    need = [cols.get("payout", "payout"), cols.get("cost", "cost"), cols.get("weight", "user_count"),
            cols.get("percentile", "lineup_percentile")]
    long = unpivot_keys(df, dims, need)
    keys = [c for c in long.columns if c not in {*need, "analysis"}]
    out = long.groupBy("analysis", *keys).agg(*roi_aggs(**cols))
    metrics = ["n_lineups", "n_entries", "weighted_roi", "top1pct_rate", "cash_rate"]
    return out.select("analysis", F.concat_ws(" / ", *keys).alias("bucket"), *metrics)


#: The one-dimensional tables and cross-tabs of a full discovery run.
ONE_DIM = {
    "ownership": ["total_own_band"], "min_own": ["min_own_band"], "max_own": ["max_own_band"],
    "salary_remaining": ["salary_remaining_band"], "favorite_count": ["fav_count_band"],
    "implied_prob_sum": ["prob_sum_band"], "own_prob_ratio": ["own_prob_band"], "tossup_count": ["tossup_label"],
    "duplication": ["dupe_band"], "contest_family": ["contest_family"],
}
CROSS_TABS = {
    "ownership_by_slate": ["slate_size", "total_own_band"], "ownership_by_fee": ["fee_tier", "total_own_band"],
    "ownership_by_family": ["contest_family", "total_own_band"], "fav_count_by_slate": ["slate_size", "fav_count_band"],
    "fav_count_by_fee": ["fee_tier", "fav_count_band"], "fav_count_by_family": ["contest_family", "fav_count_band"],
    "fav_count_by_fights": ["fight_count_band", "fav_count_band"],
    "ownership_by_fights": ["fight_count_band", "total_own_band"],
    "salary_by_fights": ["fight_count_band", "salary_remaining_band"],
    "duplication_by_fights": ["fight_count_band", "dupe_band"],
    "fav_count_by_fights_arch": ["fight_count_band", "contest_archetype", "fav_count_band"],
    "ownership_by_fights_arch": ["fight_count_band", "contest_archetype", "total_own_band"],
}


def discovery(df: DataFrame) -> DataFrame:
    """Every point table of the discovery run as one long table."""
    return roi_tables(add_regime_columns(df), {**ONE_DIM, **CROSS_TABS})


# --- other ROI definitions ------------------------------------------------

def contest_mean_roi(
    df: DataFrame, by: Sequence[str], *, contest="contest_id", payout="payout", cost="entry_cost",
    extra: Sequence[Column] = (), same_cost: bool = False,
) -> DataFrame:
    """Mean of per-contest ROI weighted by the contest's row count.

    Two-level aggregate: (group, contest) partials first, so a contest holding
    a third of all rows is reduced on the map side.  ``extra`` columns are
    (sum_, n_) partial pairs to carry; they are summed in the second level.

    ``same_cost`` tells that the cost is a property of the contest, the same on
    all its rows.  Mean payout times rows is then the sum of payouts, so a
    row's payout over that cost is summed per group at once and no (group,
    contest) partial, of which there are nearly as many as rows, is held.
    """
    if same_cost:
        row = ratio(F.coalesce(F.col(payout), F.lit(0.0)), F.col(cost))
        return df.groupBy(*by).agg(F.avg(row).alias("roi"), F.count(F.lit(1)).alias("n_lineups"), *extra)
    first = df.groupBy(*by, contest).agg(
        F.avg(F.coalesce(F.col(payout), F.lit(0.0))).alias("_p"), F.max(cost).alias("_c"),
        F.count(F.lit(1)).alias("_n"), *extra)
    names = [c for c in first.columns if c not in {*by, contest, "_p", "_c", "_n"}]
    roi = ratio(F.col("_p"), F.col("_c"))
    return first.groupBy(*by).agg(
        ratio(F.sum(roi * F.col("_n")), F.sum(F.when(roi.isNotNull(), F.col("_n")))).alias("roi"),
        F.sum("_n").alias("n_lineups"),
        *[F.sum(n).alias(n) for n in names])


def ratio_of_means(df: DataFrame, by: Sequence[str], payout="payout", cost="cost") -> DataFrame:
    """``mean(payout) / mean(cost)`` per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lineups"),
                               ratio(F.avg(payout), F.avg(cost)).alias("roi"))


def with_all_labels(table: DataFrame, key: str, labels: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Keep bands nobody falls into, with a count of zero."""
    spark = table.sparkSession
    frame = spark.createDataFrame([(x,) for x in labels], f"{key} string")
    return frame.join(table, key, "left").fillna(0, subset=list(counts))


def effective_entries(cap="multi_entry_max", size="contest_size", missing: int = 999) -> Column:
    """Share of the field one user may enter: ``min(cap, size) / size``."""
    s = F.col(size)
    return ratio(F.least(F.coalesce(F.col(cap), F.lit(missing)), s), s)


def scoring_thresholds(
    df: DataFrame, by: Sequence[str], *, contest="contest_id", order: Sequence[str], points="points",
    cash_line="cash_line", fractions: Mapping[str, float],
) -> DataFrame:
    """Mean score at rank ``max(1, int(n*f))``, at the cash line and of the winner.

    Ranks come from the distributed row number, so a contest with a third of
    all rows is not sorted in one task.  ``by`` must be constant in a contest.
    """
    keyed = ordered.running(df.select(*by, contest, points, cash_line, *[o.lstrip("-") for o in order if
                                                                          o.lstrip("-") not in {points, *by}]),
                            [contest], list(order), number="_rk")
    sizes = df.groupBy(contest).agg(F.count(F.lit(1)).alias("_n"))
    j = keyed.join(sizes, contest)
    at = lambda rank: F.max(F.when(F.col("_rk") == rank, F.col(points)))
    per = j.groupBy(*by, contest).agg(
        F.sum(points).alias("_sum"), F.max("_n").alias("_n"),
        at(F.lit(1)).alias("winner"),
        at(F.when(F.col(cash_line).isNotNull(), F.least(F.col(cash_line), F.col("_n")))).alias("_cash"),
        *[at(F.greatest(F.lit(1), F.floor(F.col("_n") * f))).alias(name) for name, f in fractions.items()])
    return per.groupBy(*by).agg(
        ratio(F.sum("_sum"), F.sum("_n")).alias("avg_points"),
        F.avg("_cash").alias("cash_line_points"),
        *[F.avg(name).alias(name) for name in fractions],
        F.avg("winner").alias("winner_points"),
        F.count(F.lit(1)).alias("n_contests"))


# --- profiles -------------------------------------------------------------

def profile(
    df: DataFrame, by: Sequence[str], *, value="actual_points", own="actual_ownership", salary="salary",
    per_k="salary_value", ceiling="is_ceiling", smash="is_smash", dud="is_dud", prob="close_prob",
) -> DataFrame:
    """Twelve-metric profile per group (percentiles exact and distributed)."""
    flat = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_fpts"), F.avg(own).alias("avg_own"),
        F.avg(salary).alias("avg_salary"), F.avg(per_k).alias("pts_per_1k"),
        (100 * rate(F.col(ceiling) == 1)).alias("ceil_pct"), (100 * rate(F.col(smash) == 1)).alias("smash_pct"),
        (100 * rate(F.col(dud) == 1)).alias("dud_pct"), F.avg(prob).alias("avg_prob"))
    pct = ordered.percentiles(df, by, value, {"med_fpts": 0.5, "p75_fpts": 0.75, "p90_fpts": 0.9})
    return ordered._join_by(flat, pct, by, "left")


def cohorts(df: DataFrame, named: Mapping[str, Column], metrics: Mapping[str, Column]) -> DataFrame:
    """Several overlapping named cohorts in one pass over the data.

    Each row is tagged with the cohorts it belongs to and counted once per tag;
    partial aggregation keeps the shuffle at (partitions x cohorts) rows.
    """
    tag = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))).alias("cohort")
    keep = df.select(tag, *[e.alias(f"_m_{n}") for n, e in metrics.items()])
    return keep.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"),
                                      *[F.avg(f"_m_{n}").alias(n) for n in metrics])
