"""Composition, entity performance and cross-cut profiles (D12-D16, D25, D26, C09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold import presets as P
from ledgerfold.functions import bands as B
from ledgerfold.operators import ordered as O, prices as M, returns as R, windows as W
from ledgerfold.plans.features import rounded
from ledgerfold.plans.registry import query, r6
from ledgerfold.plans.relational import COHORTS, MEMBERS, PROFILE, PROFILE_COLS, TAGS, member_panel, tagged
from ledgerfold.plans.returns import case_sql


def contest_money(t):
    """Payout and cost per contest: facts reduced before they meet the sets."""
    return t.entries.groupBy("contest_id").agg(F.sum("payout").alias("payout"), F.sum("cost").alias("cost"))


COMP = MEMBERS + f"""
, cp AS (SELECT contest_id, max(archetype) AS archetype, max({case_sql('entry_fee', P.STUDY_FEE)}) AS fee, sum((class_tier = 'S')::INT)::BIGINT AS tier_s, sum((class_tier = '?')::INT)::BIGINT AS tier_u,
  sum((close_prob > 0.5)::INT)::BIGINT AS favs, sum((close_prob >= 0.7::DOUBLE)::INT)::BIGINT AS heavy, sum((gender = 'Women''s')::INT)::BIGINT AS women, count(open_prob) = count(*) AS covered FROM mp GROUP BY 1),
mo AS (SELECT contest_id, sum(payout) AS payout, sum(cost) AS cost FROM entries GROUP BY 1), cm AS (SELECT * FROM cp JOIN mo USING (contest_id))
"""


def compositions(t):
    p = member_panel(t)
    c = p.groupBy("contest_id").agg(
        F.max("archetype").alias("archetype"), F.max(B.apply_band("entry_fee", P.STUDY_FEE)).alias("fee"),
        F.count_if(F.col("class_tier") == "S").alias("tier_s"), F.count_if(F.col("class_tier") == "?").alias("tier_u"),
        F.count_if(F.col("close_prob") > 0.5).alias("favs"), F.count_if(F.col("close_prob") >= 0.7).alias("heavy"), F.count_if(F.col("gender") == "Women's").alias("women"),
        (F.count("open_prob") == F.count(F.lit(1))).alias("covered"))
    return c.join(contest_money(t), "contest_id")


def long_roi(df, keys, dims, min_n=1):
    """Ratio-of-means ROI per (keys, dimension, value) in one aggregate."""
    arr = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), cond.alias("ok")) for d, cond in dims.items()])
    long = df.select(*keys, "payout", "cost", F.explode(arr).alias("x")).where("x.ok").select(*keys, "payout", "cost", "x.dim", "x.value")
    return R.ratio_of_means(long, [*keys, "dim", "value"]).where(F.col("n_lineups") >= min_n)


_CDIM = {"tier_s": "TRUE", "tier_u": "TRUE", "favs": "covered", "heavy": "covered", "women": "TRUE"}


def _comp_sql(key):
    parts = " UNION ALL ".join(f"SELECT {key}, '{d}' AS dim, {d}::VARCHAR AS value, payout, cost FROM cm WHERE {c}" for d, c in _CDIM.items())
    return COMP + f", l AS ({parts}) SELECT {key}, dim, value, count(*) AS n_lineups, round(avg(payout)/avg(cost), 6) AS roi FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 30"


def comp_query(t, key):
    ok = {"tier_s": F.lit(True), "tier_u": F.lit(True), "favs": F.col("covered"), "heavy": F.col("covered"), "women": F.lit(True)}
    return rounded(long_roi(compositions(t), [key], ok, 30), [key, "dim", "value", "n_lineups"], ["roi"])


@query("D12_composition_roi_by_archetype", _comp_sql("archetype"))
def _(t):
    return comp_query(t, "archetype")


@query("D12_composition_roi_by_fee", _comp_sql("fee"))
def _(t):
    return comp_query(t, "fee")


CARDED = MEMBERS + """
, cs AS (SELECT date_id, player_id, CASE row_number() OVER (PARTITION BY date_id ORDER BY salary DESC, player_id) WHEN 1 THEN 'main_event' WHEN 2 THEN 'co_main'
         WHEN 3 THEN 'main_card' WHEN 4 THEN 'main_card' WHEN 5 THEN 'main_card' ELSE 'prelim' END AS card_section
         FROM (SELECT date_id, player_id, max(salary) AS salary FROM players GROUP BY 1, 2)),
mc AS (SELECT * FROM mp JOIN cs USING (date_id, player_id))
"""


def carded(t):
    """The member panel with each member's section of the date's card."""
    d = t.players.groupBy("date_id", "player_id").agg(F.max("salary").alias("salary"))
    card = W.position_in_group(d, ["date_id"], ["-salary", "player_id"], name="card_position", labels=P.CARD_SECTIONS, default=P.CARD_DEFAULT,
                               label_name="card_section").select("date_id", "player_id", "card_section")
    return member_panel(t).join(card, ["date_id", "player_id"])


PERF_DIMS = ["salary_band", "own_band", "prob_tier", "move_dir", "fav_dog", "class_tier", "weight_class", "prob_band"]


def profile_long(df, dims):
    """The twelve-metric profile of many dimensions from one exploded pass."""
    cols = ["actual_points", "actual_ownership", "salary", "salary_value", "is_ceiling", "is_smash", "is_dud", "close_prob"]
    long = R.unpivot_keys(df, {d: [d] for d in dims}, cols, "dim").withColumnRenamed("k0", "value")
    return R.profile(long, ["dim", "value"])


@query("D13_entity_performance_tables", MEMBERS + ", l AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dim, {d} AS bucket, * FROM mp WHERE {d} IS NOT NULL" for d in PERF_DIMS) + f") SELECT dim, bucket AS \"value\", {PROFILE} FROM (SELECT * FROM l) GROUP BY 1, 2")
def _(t):
    return rounded(profile_long(member_panel(t), PERF_DIMS), ["dim", "value", "n"], PROFILE_COLS)


@query("D14_detailed_cross_profiles", MEMBERS + f"""
SELECT weight_class, fav_dog, move_dir, {PROFILE} FROM mp WHERE move_dir <> 'no_data' GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def _(t):
    m = member_panel(t).where("move_dir <> 'no_data'")
    return rounded(R.profile(m, ["weight_class", "fav_dog", "move_dir"]).where("n >= 5"), ["weight_class", "fav_dog", "move_dir", "n"], PROFILE_COLS)


# Averages of amounts in cents over 32 or 64 rows lie half-way between two
# rounded values; both engines round after the same small step up.
STEP = 1e-9


def stepped(df, keys, cols):
    return df.select(*keys, *[r6(F.col(c) + STEP).alias(c) for c in cols])


def stepped_sql(text):
    return text.replace(", 6)", f" + {STEP!r}::DOUBLE, 6)")


# Keys of the detailed report.  A condition on a section is a column that is
# NULL for the rows outside it, so one pass serves all sections.
SECTION_COLUMNS = {
    "moved": "CASE WHEN move_dir <> 'no_data' THEN move_dir END",
    "swung": "CASE WHEN move_dir IN ('steamed', 'drifted') THEN move_dir END",
    "mens_salary": "CASE WHEN gender = 'Men''s' THEN salary_band END",
    "chalk_salary": "CASE WHEN close_prob >= 0.65 THEN salary_band END",
    "low_owned": "CASE WHEN ownership BETWEEN 5 AND 15 THEN fav_dog END",
    "womens_class": "CASE WHEN gender = 'Women''s' THEN weight_class END",
    "womens_salary": "CASE WHEN gender = 'Women''s' THEN salary_band END",
    "womens_move": "CASE WHEN gender = 'Women''s' AND move_dir <> 'no_data' THEN move_dir END",
    "heavy_fav_dog": "CASE WHEN weight_class = 'LARGE' THEN fav_dog END",
    "heavy_prob": "CASE WHEN weight_class = 'LARGE' THEN prob_tier END",
    "cohort": """CASE WHEN ownership BETWEEN 5 AND 20 AND move_dir = 'steamed' AND fav_dog = 'Underdog' THEN 'low owned, steamed, underdog'
                 WHEN ownership >= 25 AND move_dir IN ('stable', 'steamed') AND fav_dog = 'Favorite' THEN 'high owned, held, favorite'
                 WHEN ownership >= 20 AND move_dir = 'drifted' THEN 'high owned, drifted' END""",
}
SECTIONS = {
    "1a": ["gender"], "1b": ["fav_dog"], "1c": ["gender", "fav_dog"], "2a": ["weight_class"], "2b": ["weight_class", "fav_dog"],
    "3a": ["salary_band", "fav_dog"], "3b": ["salary_band", "gender"], "3c": ["mens_salary", "weight_class"],
    "4a": ["moved", "fav_dog", "gender"], "4b": ["weight_class", "moved"], "4c": ["swung", "move_size"],
    "5a": ["prob_tier", "gender"], "5b": ["weight_class", "prob_tier"], "5c": ["prob_tier", "salary_band"], "5d": ["chalk_salary"],
    "6a": ["own_band", "fav_dog"], "6b": ["own_band", "gender"], "6c": ["low_owned", "prob_tier"],
    "7a": ["card_section", "fav_dog"], "7b": ["card_section", "gender"], "7c": ["card_section", "moved"], "9": ["cohort"],
    "10a": ["womens_class", "fav_dog"], "10b": ["womens_salary", "fav_dog"], "10c": ["womens_move", "fav_dog"],
    "11a": ["heavy_fav_dog"], "11b": ["heavy_prob"],
}
SECTION_MIN = {"3c": 20, "4a": 20, "4b": 15, "5b": 15, "5c": 15}


def _section_sql(name, keys):
    cols = ", ".join(f"{keys[i] if i < len(keys) else 'NULL'}::VARCHAR AS k{i}" for i in range(3))
    return f"SELECT '{name}' AS section, {cols}, * FROM sx WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in keys)


@query("D14_report_sections", CARDED + ", sx AS (SELECT *, " + ", ".join(f"{x} AS {n}" for n, x in SECTION_COLUMNS.items()) + " FROM mc), l AS ("
       + " UNION ALL ".join(_section_sql(n, ks) for n, ks in SECTIONS.items()) + f""")
SELECT section, k0, k1, k2, {stepped_sql(PROFILE)} FROM l GROUP BY 1, 2, 3, 4 HAVING count(*) >= CASE section """
       + " ".join(f"WHEN '{n}' THEN {m}" for n, m in SECTION_MIN.items()) + " ELSE 1 END")
def _(t):
    m = carded(t).withColumns({n: F.expr(x) for n, x in SECTION_COLUMNS.items()})
    cols = ["actual_points", "actual_ownership", "salary", "salary_value", "is_ceiling", "is_smash", "is_dud", "close_prob"]
    long = R.unpivot_keys(m, SECTIONS, cols, "section")
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in SECTION_MIN.items() for x in kv])[F.col("section")], F.lit(1))
    keys = ["section", "k0", "k1", "k2"]
    return stepped(R.profile(long, keys).where(F.col("n") >= least), [*keys, "n"], PROFILE_COLS)


@query("D14_volatility_by_class", MEMBERS + """
SELECT weight_class, count(*) AS n, round(avg(actual_points), 6) AS mean, round(stddev_samp(actual_points), 6) AS sd, round(stddev_samp(actual_points)/avg(actual_points), 6) AS cv,
       round(100*avg(is_dud), 6) AS dud_pct, round(quantile_cont(actual_points, 0.1), 6) AS floor_p10 FROM mp GROUP BY 1""")
def _(t):
    m = member_panel(t)
    g = m.groupBy("weight_class").agg(F.count(F.lit(1)).alias("n"), F.avg("actual_points").alias("mean"), F.stddev_samp("actual_points").alias("sd"),
                                      R.ratio(F.stddev_samp("actual_points"), F.avg("actual_points")).alias("cv"), (100 * F.avg("is_dud")).alias("dud_pct"))
    g = g.join(O.percentiles(m, ["weight_class"], "actual_points", {"floor_p10": 0.1}), "weight_class")
    return rounded(g, ["weight_class", "n"], ["mean", "sd", "cv", "dud_pct", "floor_p10"])


@query("D14_ownership_gap_profile", MEMBERS + f"""
, g AS (SELECT *, {case_sql('(ownership - 35*close_prob)', P.OWN_GAP)} AS gap_band FROM mp) SELECT gap_band, {PROFILE} FROM g WHERE gap_band IS NOT NULL GROUP BY 1""")
def _(t):
    m = member_panel(t).withColumn("gap_band", B.apply_band(F.col("ownership") - 35 * F.col("close_prob"), P.OWN_GAP)).where("gap_band IS NOT NULL")
    return rounded(R.profile(m, ["gap_band"]), ["gap_band", "n"], PROFILE_COLS)


E_DIMS = ["weight_class", "move_dir", "prob_band", "class_tier", "gender", "card_section"]


@query("D15_entity_tables_by_archetype", CARDED + ", l AS (" + " UNION ALL ".join(
    f"SELECT archetype, '{d}' AS dim, {d} AS bucket, actual_points, ownership, is_ceiling, is_dud FROM mc WHERE {d} IS NOT NULL" for d in E_DIMS) + """)
SELECT archetype, dim, bucket AS "value", count(*) AS n, round(avg(actual_points) + 1e-9::DOUBLE, 6) AS avg_points, round(avg(ownership) + 1e-9::DOUBLE, 6) AS avg_own, round(avg(is_ceiling) + 1e-9::DOUBLE, 6) AS ceiling_rate,
       round(avg(is_dud) + 1e-9::DOUBLE, 6) AS dud_rate, count(*) < 50 AS small_sample FROM l GROUP BY 1, 2, 3""")
def _(t):
    long = R.unpivot_keys(carded(t), {d: [d] for d in E_DIMS}, ["archetype", "actual_points", "ownership", "is_ceiling", "is_dud"],
                          "dim").withColumnRenamed("k0", "value")
    g = long.groupBy("archetype", "dim", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("actual_points").alias("avg_points"), F.avg("ownership").alias("avg_own"),
                                                     F.avg("is_ceiling").alias("ceiling_rate"), F.avg("is_dud").alias("dud_rate"))
    return stepped(g, ["archetype", "dim", "value", "n"], ["avg_points", "avg_own", "ceiling_rate", "dud_rate"]).withColumn("small_sample", F.col("n") < 50)


@query("D15_steam_gap_by_field_size", MEMBERS + f"""
SELECT {case_sql('contest_size', P.STUDY_FIELD)} AS field, round(avg(actual_points) FILTER (move_dir = 'steamed'), 6) AS steamed, round(avg(actual_points) FILTER (move_dir = 'drifted'), 6) AS drifted,
       round(avg(actual_points) FILTER (move_dir = 'steamed') - avg(actual_points) FILTER (move_dir = 'drifted'), 6) + 0.0::DOUBLE AS gap FROM mp GROUP BY 1""")
def _(t):
    side = lambda d: F.avg(F.when(F.col("move_dir") == d, F.col("actual_points")))
    return member_panel(t).groupBy(B.apply_band("contest_size", P.STUDY_FIELD).alias("field")).agg(
        r6(side("steamed")).alias("steamed"), r6(side("drifted")).alias("drifted"), r6(side("steamed") - side("drifted")).alias("gap"))


@query("D16_outscore_by_probability_band", MEMBERS + """
, q AS (SELECT date_id, quantile_cont(actual_points, 0.5) AS med, quantile_cont(actual_points, 0.75) AS p75 FROM mp GROUP BY 1)
SELECT prob_band, move_dir, count(*) AS n, round(avg((actual_points > med)::INT), 6) AS beat_median, round(avg((actual_points >= p75)::INT), 6) AS top_quartile,
       round(avg((actual_points > med)::INT) - avg(close_prob), 6) + 0.0::DOUBLE AS outscore_gap FROM mp JOIN q USING (date_id) GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(t):
    m = O.with_percentiles(member_panel(t), ["date_id"], "actual_points", {"med": 0.5, "p75": 0.75})
    beat = B.rate(F.col("actual_points") > F.col("med"))
    return m.groupBy("prob_band", "move_dir").agg(
        F.count(F.lit(1)).alias("n"), r6(beat).alias("beat_median"), r6(B.rate(F.col("actual_points") >= F.col("p75"))).alias("top_quartile"),
        r6(beat - F.avg("close_prob")).alias("outscore_gap")).where("n >= 5")


BAND_TABS = {"move": ["prob_band", "move_dir"], "class": ["prob_band", "weight_class"], "card": ["prob_band", "card_section"], "gender": ["prob_band", "gender"]}


@query("D16_band_cross_tabs", CARDED + ", l AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS analysis, {a} AS k0, {b} AS k1, actual_points, value AS v, is_ceiling, is_dud FROM mc WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for n, (a, b) in BAND_TABS.items()) + ") SELECT analysis, k0 AS prob_band, k1 AS \"value\", count(*) AS n, " + stepped_sql(
    "round(avg(actual_points), 6) AS avg_points, round(avg(v), 6) AS avg_value, round(100*avg(is_ceiling), 6) AS ceil_pct, round(100*avg(is_dud), 6) AS dud_pct") + " FROM l GROUP BY 1, 2, 3")
def _(t):
    long = R.unpivot_keys(carded(t), BAND_TABS, ["actual_points", "salary_value", "is_ceiling", "is_dud"])
    g = long.groupBy("analysis", F.col("k0").alias("prob_band"), F.col("k1").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("actual_points").alias("avg_points"), F.avg("salary_value").alias("avg_value"),
        (100 * F.avg("is_ceiling")).alias("ceil_pct"), (100 * F.avg("is_dud")).alias("dud_pct"))
    return stepped(g, ["analysis", "prob_band", "value", "n"], ["avg_points", "avg_value", "ceil_pct", "dud_pct"])


_MV = ["steamed", "drifted", "stable", "no_data"]


@query("D16_cross_tab_move_by_band", MEMBERS + "SELECT prob_band, " + ", ".join(f"round(avg(actual_points) FILTER (move_dir = '{m}'), 6) AS {m}" for m in _MV) + " FROM mp GROUP BY 1")
def _(t):
    return member_panel(t).groupBy("prob_band").pivot("move_dir", _MV).agg(r6(F.avg("actual_points")))


@query("D25_set_coverage", """
, c AS (SELECT contest_id, count(open_prob) AS covered, count(*) AS n FROM players GROUP BY 1)
SELECT covered, n - covered AS lacking, count(*) AS n_sets FROM c GROUP BY 1, 2""")
def _(t):
    c = t.players.groupBy("contest_id").agg(F.count("open_prob").alias("covered"), F.count(F.lit(1)).alias("n"))
    return c.groupBy("covered", (F.col("n") - F.col("covered")).alias("lacking")).agg(F.count(F.lit(1)).alias("n_sets"))


@query("D25_coverage_summary", """
SELECT count(*) AS n_rows, count(DISTINCT date_id) AS n_dates, count(DISTINCT player_id) AS n_entities, round(avg((open_prob IS NOT NULL)::INT), 6) AS open_share, round(avg(close_prob), 6) AS mean_close FROM players""")
def _(t):
    return t.players.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date_id").alias("n_dates"), F.countDistinct("player_id").alias("n_entities"),
                         r6(B.rate(F.col("open_prob").isNotNull())).alias("open_share"), r6(F.avg("close_prob")).alias("mean_close"))


@query("D26_construction_summary", MEMBERS + """
, b AS (SELECT arg_max(salary_band, v) AS best_tier FROM (SELECT salary_band, avg(value) AS v FROM mp GROUP BY 1))
SELECT round(avg(value) FILTER (fav_dog = 'Favorite'), 6) AS fav_value, round(avg(value) FILTER (fav_dog = 'Underdog'), 6) AS dog_value, round(avg(is_ceiling) FILTER (fav_dog = 'Favorite'), 6) AS fav_ceiling,
       round(avg(is_ceiling) FILTER (fav_dog = 'Underdog'), 6) AS dog_ceiling, round(avg(actual_points) FILTER (move_dir = 'steamed'), 6) AS steamed_points,
       round(avg(actual_points) FILTER (move_dir = 'drifted'), 6) AS drifted_points, any_value(best_tier) AS best_tier FROM mp, b""")
def _(t):
    m = member_panel(t)
    avg = lambda c, k, v: r6(F.avg(F.when(F.col(k) == v, F.col(c))))
    one = m.agg(avg("salary_value", "fav_dog", "Favorite").alias("fav_value"), avg("salary_value", "fav_dog", "Underdog").alias("dog_value"),
                avg("is_ceiling", "fav_dog", "Favorite").alias("fav_ceiling"), avg("is_ceiling", "fav_dog", "Underdog").alias("dog_ceiling"),
                avg("actual_points", "move_dir", "steamed").alias("steamed_points"), avg("actual_points", "move_dir", "drifted").alias("drifted_points"))
    best = m.groupBy("salary_band").agg(F.avg("salary_value").alias("v")).agg(F.max_by("salary_band", "v").alias("best_tier"))
    return O.attach_row(one, best)


@query("D14_named_cohort_profiles", MEMBERS + """
, l AS (SELECT 'leverage' AS cohort, * FROM mp WHERE ownership BETWEEN 5 AND 20 AND move_dir = 'steamed' AND fav_dog = 'Underdog'
 UNION ALL SELECT 'lock', * FROM mp WHERE ownership >= 25 AND move_dir IN ('stable', 'steamed') AND fav_dog = 'Favorite'
 UNION ALL SELECT 'trap', * FROM mp WHERE ownership >= 20 AND move_dir = 'drifted' UNION ALL SELECT 'low_owned', * FROM mp WHERE ownership BETWEEN 5 AND 15)
SELECT cohort, round(quantile_cont(actual_points, 0.1), 6) AS p10, round(quantile_cont(actual_points, 0.5), 6) AS p50 FROM l GROUP BY 1""")
def _(t):
    named = {k: v for k, v in COHORTS.items() if k != "all"}
    tag = F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in named.items()]))).alias("cohort")
    long = member_panel(t).select("actual_points", tag)
    return rounded(O.percentiles(long, ["cohort"], "actual_points", {"p10": 0.1, "p50": 0.5}), ["cohort"], ["p10", "p50"])


@query("C09_slate_report", TAGS.replace("SELECT player_id, contest_id, concat_ws", ", tg AS (SELECT player_id, contest_id, concat_ws", 1) + """),
fm AS (SELECT player_id, avg(actual_points) AS form FROM players GROUP BY 1)
SELECT p.day_id, p.player_id, p.contest_id, p.salary, round(form, 9) AS form, tags FROM players p JOIN tg USING (player_id, contest_id) LEFT JOIN fm USING (player_id) WHERE tags <> ''""")
def _(t):
    form = t.players.groupBy("player_id").agg(r6(F.avg("actual_points"), 9).alias("form"))
    return tagged(t).where("tags <> ''").join(form, "player_id", "left").select("day_id", "player_id", "contest_id", "salary", "form", "tags")
