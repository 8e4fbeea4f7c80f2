"""Scans, predicates, joins, aggregates, ordering and set operations (S, P, J, G, O, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold import presets as P
from ledgerfold.functions import bands as B, scalars as S
from ledgerfold.operators import folds as V, ordered as O, prices as M, returns as R, windows as W
from ledgerfold.plans.features import rounded
from ledgerfold.plans.registry import query, r6
from ledgerfold.plans.returns import case_sql, regime_entries, REGIMES
from ledgerfold.sources import tables as T

# ---- scans ---------------------------------------------------------------


@query("S01_scan_projected", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def _(t):
    return t.read("orders", "o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("S02_base_rows", """
SELECT player_id, contest_id, date_id, salary, round(ownership, 6) AS ownership FROM players
WHERE contest_id <> 77 AND ownership IS NOT NULL AND contest_size >= 1000""")
def _(t):
    p = t.players.where((F.col("contest_id") != 77) & F.col("ownership").isNotNull() & (F.col("contest_size") >= 1000))
    return rounded(p, ["player_id", "contest_id", "date_id", "salary"], ["ownership"])


SCRAPED = """
, sc AS (SELECT contest_id, sum(payout*user_count) AS scraped FROM entries GROUP BY 1),
fc AS (SELECT contest_id, count(DISTINCT player_id)//2 AS n_fights FROM players GROUP BY 1),
ws AS (SELECT c.*, coalesce(scraped, 0) AS scraped_prizes, n_fights, CASE WHEN total_prizes > 0 THEN coalesce(scraped, 0)/(total_prizes*20) END AS ratio
       FROM contests c LEFT JOIN sc USING (contest_id) LEFT JOIN fc USING (contest_id))
"""


def scraped(t, only):
    c = t.contests.withColumn("total_prizes", F.col("total_prizes") * 20)
    return T.well_scraped(c, t.entries, t.players, tolerance=0.4, only=only)


@query("S03_contests_with_completeness", SCRAPED + """
SELECT contest_id, n_fights, round(scraped_prizes, 4) AS scraped_prizes, round(ratio, 6) AS payout_ratio,
       coalesce(ratio BETWEEN 0.6 AND 1.4, false) AS is_well_scraped FROM ws""")
def _(t):
    return scraped(t, False).select("contest_id", "n_fights", r6("scraped_prizes", 4).alias("scraped_prizes"),
                                    r6("payout_ratio").alias("payout_ratio"), "is_well_scraped")


@query("S04_entries_of_complete_contests", SCRAPED + """
SELECT e.contest_id, part_id, line_no, round(payout, 4) AS payout FROM entries e
WHERE contest_id IN (SELECT contest_id FROM ws WHERE ratio BETWEEN 0.6 AND 1.4) AND favorite_count IS NOT NULL""")
def _(t):
    keep = scraped(t, True).select("contest_id")
    e = t.entries.where("favorite_count IS NOT NULL").join(keep, "contest_id", "left_semi")
    return rounded(e, ["contest_id", "part_id", "line_no"], ["payout"], 4)


@query("S10_table_profile", """
SELECT 'orders' AS table_name, count(*) AS n_rows, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first,
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT o_orderdate) AS n_dates FROM orders
UNION ALL SELECT 'lineitem', count(*), strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S'), strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S'), count(DISTINCT l_shipdate) FROM lineitem
UNION ALL SELECT 'part', count(*), NULL, NULL, 0 FROM part""")
def _(t):
    return T.profile_tables({"orders": t.orders, "lineitem": t.lineitem, "part": t.part},
                            {"orders": "o_orderdate", "lineitem": "l_shipdate"})


@query("S11_fingerprint")
def _(t):
    out = T.fingerprint(t.orders, "orders")
    for n in ("lineitem", "part", "customer"):
        out = out.unionByName(T.fingerprint(t.read(n), n))
    return out


WOMENS = ["ECONOMY", "SMALL"]  # the part types that play the women's classes


def member_panel(t):
    """Members with price direction, value, outcome flags and class labels."""
    p = t.players.withColumns({
        "actual_ownership": F.col("ownership"),
        "salary_value": R.ratio(F.col("actual_points"), F.col("salary") / 1000),
        "is_ceiling": (F.col("actual_points") / (F.col("salary") / 1000) >= 8).cast("int"),
        "is_smash": (F.col("actual_points") / (F.col("salary") / 1000) >= 10).cast("int"),
        "is_dud": (F.col("actual_points") < 10).cast("int"),
        "is_favorite": (F.col("close_prob") > 0.5).cast("int"),
        "fav_dog": F.when(F.col("close_prob") > 0.5, "Favorite").otherwise("Underdog"),
        "move_dir": M.move_direction("line_move", missing="no_data"),
        "prob_tier": B.apply_band("close_prob", P.PROB_TIER), "prob_band": B.apply_band("close_prob", P.PROB_BAND),
        "own_band": B.apply_band("ownership", P.ENTITY_OWN), "salary_band": B.apply_band("salary", P.ENTITY_SALARY),
        "class_tier": B.map_label("weight_class", {"ECONOMY": "S", "PROMO": "A", "STANDARD": "B"}, "?"),
        "archetype": R.archetype(), "gender": R.gender(womens=WOMENS),
        "move_size": B.apply_band(F.abs("line_move"), P.MOVE_SIZE),
    })
    return p


MEMBERS = f"""
, mp AS (SELECT *, actual_points/(salary/1000) AS value, (actual_points/(salary/1000) >= 8)::INT AS is_ceiling,
   (actual_points/(salary/1000) >= 10)::INT AS is_smash, (actual_points < 10)::INT AS is_dud,
   CASE WHEN close_prob > 0.5 THEN 'Favorite' ELSE 'Underdog' END AS fav_dog,
   CASE WHEN line_move IS NULL THEN 'no_data' WHEN line_move > 0.02::DOUBLE THEN 'steamed' WHEN line_move < -0.02::DOUBLE THEN 'drifted' ELSE 'stable' END AS move_dir,
   {case_sql('close_prob', P.PROB_TIER)} AS prob_tier, {case_sql('close_prob', P.PROB_BAND)} AS prob_band,
   {case_sql('ownership', P.ENTITY_OWN)} AS own_band, {case_sql('salary', P.ENTITY_SALARY)} AS salary_band,
   CASE weight_class WHEN 'ECONOMY' THEN 'S' WHEN 'PROMO' THEN 'A' WHEN 'STANDARD' THEN 'B' ELSE '?' END AS class_tier,
   CASE WHEN multi_entry_max IS NULL THEN 'UNLIMITED' WHEN multi_entry_max = 1 THEN 'SE' WHEN multi_entry_max <= 20 THEN 'LIMITED'
        WHEN multi_entry_max <= 150 THEN '150-Max' ELSE 'UNLIMITED' END AS archetype,
   CASE WHEN weight_class IN ('ECONOMY', 'SMALL') THEN 'Women''s' ELSE 'Men''s' END AS gender,
   {case_sql('abs(line_move)', P.MOVE_SIZE)} AS move_size FROM players)
"""


@query("S12_member_panel", MEMBERS + """
SELECT player_id, contest_id, round(value, 9) AS salary_value, is_ceiling, is_smash, is_dud, fav_dog, move_dir, prob_tier, prob_band,
       own_band, salary_band, class_tier, archetype FROM mp""")
def _(t):
    return member_panel(t).select("player_id", "contest_id", r6("salary_value", 9).alias("salary_value"), "is_ceiling", "is_smash", "is_dud",
                                  "fav_dog", "move_dir", "prob_tier", "prob_band", "own_band", "salary_band", "class_tier", "archetype")


FEE_B, FIELD_B = case_sql("entry_fee", P.STUDY_FEE), case_sql("contest_size", P.STUDY_FIELD)


@query("S13_contest_panel", f"""
SELECT contest_id, {FEE_B} AS fee_tier, {FIELD_B} AS field, CASE WHEN multi_entry_max = 1 THEN 'SE' WHEN multi_entry_max BETWEEN 3 AND 18 THEN 'LIMITED'
 WHEN multi_entry_max = 20 THEN '20-Max' WHEN multi_entry_max = 150 THEN '150-Max' ELSE 'UNLIMITED' END AS archetype FROM contests""")
def _(t):
    return t.contests.select("contest_id", B.apply_band("entry_fee", P.STUDY_FEE).alias("fee_tier"),
                             B.apply_band("contest_size", P.STUDY_FIELD).alias("field"), R.archetype(taxonomy="study").alias("archetype"))


# ---- predicates ------------------------------------------------------------

@query("P01_sentinel_and_not_null", "SELECT contest_id, cash_line FROM contests WHERE contest_id <> 42 AND cash_line IS NOT NULL")
def _(t):
    return t.contests.where((F.col("contest_id") != 42) & F.col("cash_line").isNotNull()).select("contest_id", "cash_line")


@query("P04_date_match", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def _(t):
    return t.orders.where(F.to_date("o_orderdate").between("1996-01-01", "1996-12-31")).select("o_orderkey")


@query("P05_relative_tolerance", """
SELECT contest_id FROM contests WHERE entry_fee > 0 AND contest_size/(entry_fee*1000) BETWEEN 0.94 AND 1.06""")
def _(t):
    return t.contests.where(R.ratio(F.col("contest_size"), F.col("entry_fee") * 1000).between(0.94, 1.06)).select("contest_id")


@query("P06_set_membership", """
SELECT contest_id FROM contests WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND fight_count IN (10, 12, 14)""")
def _(t):
    chosen = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return t.contests.where(F.col("fight_count").isin(10, 12, 14)).join(chosen, "user_id", "left_semi").select("contest_id")


@query("P07_right_closed_bands", f"""
SELECT p_partkey, {case_sql('p_size', {'edges': [0, 10, 20, 30, 40, 50], 'labels': list('abcde')})} AS size_band FROM part""")
def _(t):
    return t.part.select("p_partkey", B.band("p_size", [0, 10, 20, 30, 40, 50], list("abcde")).alias("size_band"))


@query("P08_left_closed_bands", MEMBERS + "SELECT prob_band, count(*) AS n FROM mp GROUP BY 1")
def _(t):
    return member_panel(t).groupBy("prob_band").agg(F.count(F.lit(1)).alias("n"))


@query("P09_salary_tiers", f"SELECT salary, {case_sql('salary', P.SALARY_TIER)} AS tier, count(*) AS n FROM players GROUP BY 1, 2")
def _(t):
    return t.players.groupBy("salary", B.apply_band("salary", P.SALARY_TIER).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("P10_case_tiers", """
SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'platinum' WHEN c_acctbal >= 5000 THEN 'gold' WHEN c_acctbal >= 0 THEN 'silver' ELSE 'debt' END AS tier
FROM customer""")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", B.first_rule([(b >= 7500, "platinum"), (b >= 5000, "gold"), (b >= 0, "silver")], "debt").alias("tier"))


@query("P11_fee_and_field_buckets", f"SELECT {FEE_B} AS fee, {FIELD_B} AS field, count(*) AS n FROM contests GROUP BY 1, 2")
def _(t):
    return t.contests.groupBy(B.apply_band("entry_fee", P.STUDY_FEE).alias("fee"), B.apply_band("contest_size", P.STUDY_FIELD).alias("field")).agg(
        F.count(F.lit(1)).alias("n"))


@query("P12_archetypes", """
SELECT contest_id,
 CASE WHEN multi_entry_max IS NULL THEN 'UNLIMITED' WHEN multi_entry_max = 1 THEN 'SE' WHEN multi_entry_max <= 20 THEN 'LIMITED' WHEN multi_entry_max <= 150 THEN '150-Max' ELSE 'UNLIMITED' END AS a,
 CASE WHEN multi_entry_max = 1 THEN 'SE' WHEN multi_entry_max BETWEEN 3 AND 18 THEN 'LIMITED' WHEN multi_entry_max = 20 THEN '20-Max' WHEN multi_entry_max = 150 THEN '150-Max' ELSE 'UNLIMITED' END AS b,
 CASE WHEN multi_entry_max > 1 THEN 'MME' WHEN contest_size <= 20 THEN 'SE' ELSE 'limited' END AS c,
 CASE multi_entry_max WHEN 1 THEN 'Single Entry' WHEN 3 THEN '3-Max' WHEN 20 THEN '20-Max' WHEN 150 THEN '150-Max' WHEN 2 THEN 'Limited' WHEN 18 THEN 'Limited' ELSE 'MME' END AS d
FROM contests""")
def _(t):
    return t.contests.select("contest_id", *[R.archetype(taxonomy=x).alias(n) for n, x in zip("abcd", ("discovery", "study", "features", "mart"))])


@query("P13_family_regex", """
SELECT CASE WHEN o_orderpriority ILIKE '%low%' THEN 'low' WHEN o_orderpriority ILIKE '%high%' THEN 'high'
       WHEN regexp_matches(o_orderpriority, '^[0-9]-URGENT') THEN 'urgent' ELSE 'Other' END AS family, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    fam = B.regex_family("o_orderpriority", [("low", "low"), ("high(?!er)", "high"), (r"^\d-urgent", "urgent")])
    return t.orders.groupBy(fam.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("P15_move_size", MEMBERS + f"""
, q AS (SELECT abs(line_move) AS am FROM mp) SELECT {case_sql('am', P.MOVE_SIZE)} AS size, count(*) AS n FROM q GROUP BY 1""")
def _(t):
    return member_panel(t).groupBy(B.apply_band(F.abs("line_move"), P.MOVE_SIZE).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("P16_outcome_flags", MEMBERS + """
, q AS (SELECT date_id, quantile_cont(actual_points, 0.5) AS med FROM mp GROUP BY 1)
SELECT date_id, sum(is_ceiling)::BIGINT AS ceilings, sum(is_smash)::BIGINT AS smashes, sum((value >= 6)::INT)::BIGINT AS solids, sum(is_dud)::BIGINT AS duds,
       sum((actual_points = 0 OR actual_points < 0.3*med)::INT)::BIGINT AS relative_duds FROM mp JOIN q USING (date_id) GROUP BY 1""")
def _(t):
    m = O.with_percentiles(member_panel(t), ["date_id"], "actual_points", {"med": 0.5})
    x = F.col("actual_points")
    return m.groupBy("date_id").agg(
        F.sum("is_ceiling").alias("ceilings"), F.sum("is_smash").alias("smashes"), F.sum((F.col("salary_value") >= 6).cast("int")).alias("solids"),
        F.sum("is_dud").alias("duds"), F.sum(((x == 0) | (x < 0.3 * F.col("med"))).cast("int")).alias("relative_duds"))


@query("P17_category_map", MEMBERS + "SELECT weight_class, class_tier, count(*) AS n FROM mp GROUP BY 1, 2")
def _(t):
    return member_panel(t).groupBy("weight_class", "class_tier").agg(F.count(F.lit(1)).alias("n"))


@query("P18_quality_tier", """
SELECT player_id, contest_id, CASE WHEN close_prob IS NULL THEN 'none' WHEN open_prob IS NOT NULL THEN 'high' ELSE 'medium' END AS tier FROM players""")
def _(t):
    return t.players.select("player_id", "contest_id", M.quality_tier("close_prob", "open_prob").alias("tier"))


@query("P19_quality_gate", """
, q AS (SELECT day_id, (avg((open_prob IS NOT NULL)::INT) >= 0.8::DOUBLE)::INT AS hq FROM players GROUP BY 1)
SELECT player_id, contest_id, CASE WHEN coalesce(hq, 0) = 1 THEN round(close_prob, 6) END AS prob FROM players LEFT JOIN q USING (day_id)""")
def _(t):
    q = t.players.groupBy("day_id").agg((B.rate(F.col("open_prob").isNotNull()) >= 0.8).cast("int").alias("hq"))
    p = t.players.join(q, "day_id", "left")
    return p.select("player_id", "contest_id", F.when(F.coalesce("hq", F.lit(0)) == 1, r6("close_prob")).alias("prob"))


TAGS = """
, c9 AS (SELECT *, close_prob AS cash, 1 - close_prob AS bust, actual_points AS lev, actual_points/nullif(ownership, 0) AS ceil_own, ownership - 20*close_prob AS od FROM players)
SELECT player_id, contest_id, concat_ws(' | ', CASE WHEN cash <> 0 AND cash > 0.55::DOUBLE AND bust <> 0 AND bust < 0.35::DOUBLE AND close_prob > 0.5 THEN 'CASH_LOCK' END,
  CASE WHEN lev > 50 AND ownership <> 0 AND ownership < 15 AND ceil_own > 4 THEN 'GPP_LEV' END, CASE WHEN od > 10 THEN 'TRAP' END,
  CASE WHEN bust > 0.45::DOUBLE THEN 'DUD_RISK' END) AS tags FROM c9"""


def tag_rules(cash="cash", bust="bust", fav="is_favorite", lev="lev", own="ownership", ceil_own="ceil_own", delta="od"):
    """The four report tags; zero counts as "no value"."""
    c = F.col
    return [("CASH_LOCK", (c(cash) != 0) & (c(cash) > 0.55) & (c(bust) != 0) & (c(bust) < 0.35) & (c(fav) == 1)),
            ("GPP_LEV", (c(lev) > 50) & (c(own) != 0) & (c(own) < 15) & (c(ceil_own) > 4)),
            ("TRAP", c(delta) > 10), ("DUD_RISK", c(bust) > 0.45)]


def tagged(t):
    p = t.players.withColumns({
        "cash": F.col("close_prob"), "bust": 1 - F.col("close_prob"), "is_favorite": (F.col("close_prob") > 0.5).cast("int"),
        "lev": F.col("actual_points"), "ceil_own": F.try_divide("actual_points", "ownership"), "od": F.col("ownership") - 20 * F.col("close_prob")})
    return p.withColumn("tags", B.tags(tag_rules()))


@query("P20_tagging", TAGS)
def _(t):
    return tagged(t).select("player_id", "contest_id", "tags")


COHORTS = {
    "leverage": "ownership BETWEEN 5 AND 20 AND move_dir = 'steamed' AND is_favorite = 0",
    "lock": "ownership >= 25 AND move_dir IN ('stable', 'steamed') AND is_favorite = 1",
    "trap": "ownership >= 20 AND move_dir = 'drifted'", "low_owned": "ownership BETWEEN 5 AND 15", "all": "true",
}


@query("P21_named_cohorts", MEMBERS + """
, l AS (SELECT 'leverage' AS cohort, * FROM mp WHERE ownership BETWEEN 5 AND 20 AND move_dir = 'steamed' AND fav_dog = 'Underdog'
 UNION ALL SELECT 'lock', * FROM mp WHERE ownership >= 25 AND move_dir IN ('stable', 'steamed') AND fav_dog = 'Favorite'
 UNION ALL SELECT 'trap', * FROM mp WHERE ownership >= 20 AND move_dir = 'drifted' UNION ALL SELECT 'low_owned', * FROM mp WHERE ownership BETWEEN 5 AND 15
 UNION ALL SELECT 'all', * FROM mp)
SELECT cohort, count(*) AS n, round(avg(actual_points), 6) AS avg_points, round(avg(is_ceiling), 6) AS ceiling_rate, round(avg(is_dud), 6) AS dud_rate FROM l GROUP BY 1""")
def _(t):
    c = R.cohorts(member_panel(t), {k: F.expr(v) for k, v in COHORTS.items()}, {"avg_points": F.col("actual_points"), "ceiling_rate": F.col("is_ceiling"), "dud_rate": F.col("is_dud")})
    return rounded(c, ["cohort", "n"], ["avg_points", "ceiling_rate", "dud_rate"])


@query("P22_leakage_correlation", """
SELECT * FROM (SELECT 'ownership' AS feature, round(corr(ownership, actual_points), 6) AS r FROM players UNION ALL SELECT 'close_prob', round(corr(close_prob, actual_points), 6) FROM players
UNION ALL SELECT 'salary', round(corr(salary, actual_points), 6) FROM players) WHERE abs(r) < 0.99""")
def _(t):
    one = t.players.agg(*[F.corr(c, "actual_points").alias(c) for c in ("ownership", "close_prob", "salary")])
    long = one.unpivot([], ["ownership", "close_prob", "salary"], "feature", "r")
    return long.where(F.abs("r") < 0.99).select("feature", r6("r").alias("r"))


@query("P24_regime_filter", REGIMES + "SELECT total_own_band, count(*) AS n FROM e WHERE slate_size = 'FULL' AND fee_tier = 'MID' GROUP BY 1")
def _(t):
    return regime_entries(t).where("slate_size = 'FULL' AND fee_tier = 'MID'").groupBy("total_own_band").agg(F.count(F.lit(1)).alias("n"))


@query("P25_dated_projection", "SELECT contest_id, strftime(contest_date, '%Y-%m-%d') AS d, contest_size AS x, round(total_prizes, 2) AS y FROM contests")
def _(t):
    return t.contests.select("contest_id", F.date_format("contest_date", "yyyy-MM-dd").alias("d"), F.col("contest_size").alias("x"), r6("total_prizes", 2).alias("y"))


# ---- joins -----------------------------------------------------------------

@query("J01_inner_and_left_joins", """
SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <= 2""")
def _(t):
    n = t.nation.where("n_regionkey <= 2")
    c = t.customer.join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("J03_star_join", """
SELECT r_name, p_brand, c_mktsegment, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""")
def _(t):
    sup = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("s_suppkey", "r_name")
    f = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(sup, F.col("s_suppkey") == F.col("l_suppkey")))
    return f.groupBy("r_name", "p_brand", "c_mktsegment").agg(r6(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("J04_join_to_aggregate", """
SELECT contest_id, n_lines, round(spend, 2) AS spend FROM contests LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS spend FROM lineitem GROUP BY 1) ON l_orderkey = contest_id""")
def _(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.count(F.lit(1)).alias("n_lines"), r6(F.sum("l_extendedprice"), 2).alias("spend"))
    return t.contests.select("contest_id").join(a, "contest_id", "left")


@query("J05_feature_fan", """
, a AS (SELECT player_id, date_id, avg(ownership) AS o FROM players GROUP BY 1, 2), b AS (SELECT player_id, avg(actual_points) AS f FROM players GROUP BY 1),
d AS (SELECT date_id, count(*) AS n FROM players GROUP BY 1), g AS (SELECT weight_class, avg(close_prob) AS p FROM players GROUP BY 1)
SELECT player_id, contest_id, round(o, 6) AS own, round(f, 9) AS form, n AS slate_rows, round(p, 6) AS class_prob
FROM players LEFT JOIN a USING (player_id, date_id) LEFT JOIN b USING (player_id) LEFT JOIN d USING (date_id) LEFT JOIN g USING (weight_class)""")
def _(t):
    p = t.players
    a = p.groupBy("player_id", "date_id").agg(r6(F.avg("ownership")).alias("own"))
    b = p.groupBy("player_id").agg(r6(F.avg("actual_points"), 9).alias("form"))
    d = p.groupBy("date_id").agg(F.count(F.lit(1)).alias("slate_rows"))
    g = p.groupBy("weight_class").agg(r6(F.avg("close_prob")).alias("class_prob"))
    out = p.select("player_id", "contest_id", "date_id", "weight_class")
    return out.join(a, ["player_id", "date_id"], "left").join(b, "player_id", "left").join(d, "date_id", "left").join(
        g, "weight_class", "left").select("player_id", "contest_id", "own", "form", "slate_rows", "class_prob")


@query("J06_decorrelated_name_join", """
SELECT doc_id, c_custkey FROM labels JOIN customer ON c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = doc_id)""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c_custkey")).distinct()
    return t.labels.select("doc_id").join(o, "doc_id").join(t.customer.select("c_custkey"), "c_custkey").select("doc_id", "c_custkey")


@query("J07_first_contest_of_date", """
, f AS (SELECT day_id, arg_max(contest_id, contest_size::BIGINT*1000000000 - contest_id) AS contest_id FROM contests GROUP BY 1)
SELECT day_id, player_id, salary FROM players JOIN f USING (day_id, contest_id)""")
def _(t):
    first = W.keep_first(t.contests.select("day_id", "contest_id", "contest_size"), ["day_id"], ["-contest_size", "contest_id"])
    return t.players.join(first.select("day_id", "contest_id"), ["day_id", "contest_id"]).select("day_id", "player_id", "salary")


@query("J08_scalar_subquery_join", """
SELECT contest_id, (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = contest_id) AS top_price FROM contests""")
def _(t):
    m = t.lineitem.groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.max("l_extendedprice").alias("top_price"))
    return t.contests.select("contest_id").join(m, "contest_id", "left")


@query("J09_conditional_pairing", """
SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'O') AS open_max, max(o_totalprice) FILTER (o_orderstatus = 'F') AS closed_max FROM orders GROUP BY 1""")
def _(t):
    side = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return t.orders.groupBy("o_custkey").agg(side("O").alias("open_max"), side("F").alias("closed_max"))


@query("J10_date_archetype_expansion", MEMBERS + """
, da AS (SELECT DISTINCT date_id, archetype FROM mp), pd AS (SELECT date_id, player_id, avg(actual_points) AS pts FROM mp GROUP BY 1, 2)
SELECT da.archetype, count(*) AS n, round(avg(pts), 6) AS avg_points FROM pd JOIN da USING (date_id) GROUP BY 1""")
def _(t):
    m = member_panel(t)
    da = m.select("date_id", "archetype").distinct()
    pd = m.groupBy("date_id", "player_id").agg(F.avg("actual_points").alias("pts"))
    return pd.join(da, "date_id").groupBy("archetype").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("pts")).alias("avg_points"))


@query("J14_semi_join", "SELECT contest_id FROM contests WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = contest_id AND l_discount >= 0.1)")
def _(t):
    li = t.read("lineitem", "l_discount >= 0.1").select(F.col("l_orderkey").alias("contest_id"))
    return t.contests.join(li, "contest_id", "left_semi").select("contest_id")


@query("J17_lookup_join", "SELECT s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def _(t):
    n = t.nation.where("n_nationkey < 20")
    return t.supplier.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


# ---- aggregates ------------------------------------------------------------

@query("G01_group_aggregates", """
SELECT brand, count(*) AS n, round(sum(actual_points), 2) AS total, round(avg(actual_points), 6) AS mean, max(weight_class) AS any_class FROM players GROUP BY 1""")
def _(t):
    return t.players.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("actual_points"), 2).alias("total"),
                                          r6(F.avg("actual_points")).alias("mean"), F.max("weight_class").alias("any_class"))


@query("G02_count_distinct", """
SELECT date_id, count(DISTINCT player_id) AS n_players, count(DISTINCT CASE WHEN close_prob > 0.5 THEN player_id END) AS n_favorites FROM players GROUP BY 1""")
def _(t):
    return t.players.groupBy("date_id").agg(F.countDistinct("player_id").alias("n_players"),
                                            F.countDistinct(F.when(F.col("close_prob") > 0.5, F.col("player_id"))).alias("n_favorites"))


@query("G03_conditional_having", """
SELECT user_id, count(*) AS n, sum((status = 'F')::INT)::BIGINT AS wins FROM contests GROUP BY 1 HAVING count(*) >= 10""")
def _(t):
    return t.contests.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "F").alias("wins")).where("n >= 10")


@query("G05_predicate_rate", """
SELECT brand, round(avg(CASE WHEN open_prob > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM players GROUP BY 1""")
def _(t):
    return t.players.groupBy("brand").agg(r6(B.rate(F.col("open_prob") > 0.5)).alias("rate"))


@query("G06_group_percentiles", """
SELECT weight_class, round(quantile_cont(actual_points, 0.1), 6) AS p10, round(quantile_cont(actual_points, 0.25), 6) AS p25,
       round(quantile_cont(actual_points, 0.5), 6) AS p50, round(quantile_cont(actual_points, 0.75), 6) AS p75, round(quantile_cont(actual_points, 0.9), 6) AS p90
FROM players GROUP BY 1""")
def _(t):
    q = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return rounded(O.percentiles(t.players, ["weight_class"], "actual_points", q), ["weight_class"], list(q))


@query("G07_dispersion", """
SELECT brand, round(stddev_samp(actual_points), 6) AS sd, round(stddev_samp(actual_points)/avg(actual_points), 6) AS cv FROM players GROUP BY 1""")
def _(t):
    return t.players.groupBy("brand").agg(r6(F.stddev_samp("actual_points")).alias("sd"),
                                          r6(R.ratio(F.stddev_samp("actual_points"), F.avg("actual_points"))).alias("cv"))


PROFILE = """count(*) AS n, round(avg(actual_points), 6) AS avg_fpts, round(quantile_cont(actual_points, 0.5), 6) AS med_fpts, round(quantile_cont(actual_points, 0.75), 6) AS p75_fpts,
 round(quantile_cont(actual_points, 0.9), 6) AS p90_fpts, round(avg(ownership), 6) AS avg_own, round(avg(salary), 6) AS avg_salary, round(avg(value), 6) AS pts_per_1k,
 round(100*avg(is_ceiling), 6) AS ceil_pct, round(100*avg(is_smash), 6) AS smash_pct, round(100*avg(is_dud), 6) AS dud_pct, round(avg(close_prob), 6) AS avg_prob"""
PROFILE_COLS = ["avg_fpts", "med_fpts", "p75_fpts", "p90_fpts", "avg_own", "avg_salary", "pts_per_1k", "ceil_pct", "smash_pct", "dud_pct", "avg_prob"]


@query("G08_profile", MEMBERS + f"SELECT own_band, fav_dog, {PROFILE} FROM mp GROUP BY 1, 2")
def _(t):
    return rounded(R.profile(member_panel(t), ["own_band", "fav_dog"]), ["own_band", "fav_dog", "n"], PROFILE_COLS)


@query("G09_small_sample_flag", MEMBERS + "SELECT brand, prob_tier, count(*) AS n, count(*) < 50 AS small_sample FROM mp GROUP BY 1, 2 HAVING count(*) >= 10")
def _(t):
    return member_panel(t).groupBy("brand", "prob_tier").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").withColumn("small_sample", F.col("n") < 50)


@query("G10_set_composition", MEMBERS + """
SELECT contest_id, max(salary) - min(salary) AS spread, sum((salary >= 8500)::INT)::BIGINT AS n_high, sum((close_prob > 0.5)::INT)::BIGINT AS favs,
       sum((close_prob >= 0.7::DOUBLE)::INT)::BIGINT AS heavy_favs, round(avg(close_prob), 6) AS mean_prob, count(open_prob) AS coverage, sum((class_tier = 'S')::INT)::BIGINT AS tier_s
FROM mp GROUP BY 1""")
def composition(t):
    p = F.col("close_prob")
    return member_panel(t).groupBy("contest_id").agg(
        (F.max("salary") - F.min("salary")).alias("spread"), F.count_if(F.col("salary") >= 8500).alias("n_high"), F.count_if(p > 0.5).alias("favs"),
        F.count_if(p >= 0.7).alias("heavy_favs"), r6(F.avg(p)).alias("mean_prob"), F.count("open_prob").alias("coverage"), F.count_if(F.col("class_tier") == "S").alias("tier_s"))


@query("G11_derived_set_features", """
SELECT contest_id, sum((close_prob > 0.5)::INT)::BIGINT AS favorite_count, sum((close_prob BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE)::INT)::BIGINT AS tossup_count,
       round(sum(close_prob), 6) AS implied_prob_sum, round(avg(ownership/close_prob), 9) AS own_prob_ratio FROM players GROUP BY 1""")
def _(t):
    p = F.col("close_prob")
    return t.players.groupBy("contest_id").agg(F.count_if(p > 0.5).alias("favorite_count"), F.count_if(p.between(0.4, 0.6)).alias("tossup_count"),
                                               r6(F.sum(p)).alias("implied_prob_sum"), r6(F.avg(F.try_divide("ownership", "close_prob")), 9).alias("own_prob_ratio"))


@query("G12_share_within_date", """
, b AS (SELECT date_id, brand, count(*) AS n FROM players GROUP BY 1, 2) SELECT date_id, brand, round(n/sum(n) OVER (PARTITION BY date_id)*100, 6) AS share FROM b""")
def _(t):
    b = t.players.groupBy("date_id", "brand").agg(F.count(F.lit(1)).alias("n"))
    return rounded(W.share_within(b, ["date_id"], "n", "share"), ["date_id", "brand"], ["share"])


@query("G13_frequency_table", "SELECT brand, count(*) AS n, round(100.0::DOUBLE*count(*)/(SELECT count(*) FROM players), 6) AS pct FROM players GROUP BY 1")
def _(t):
    b = t.players.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return rounded(W.share_within(b, [], "n", "pct"), ["brand", "n"], ["pct"])


@query("G14_event_view", "SELECT date_id, count(*) AS n, round(avg(ownership), 6) AS avg_own, max(actual_points) AS best, min(salary) AS cheapest FROM players GROUP BY 1")
def _(t):
    return t.players.groupBy("date_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ownership")).alias("avg_own"), F.max("actual_points").alias("best"), F.min("salary").alias("cheapest"))


@query("G16_earliest_latest", """
SELECT user_id, min_by(value, {'t': ts, 'e': event_id}) AS first_value, max_by(value, {'t': ts, 'e': event_id}) AS last_value FROM events GROUP BY 1""")
def _(t):
    o = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.min_by("value", o).alias("first_value"), F.max_by("value", o).alias("last_value"))


_PIV = ["<100%", "100-125%", "125-150%", "150-175%", "175-200%", "200%+"]


@query("G17_pivot", REGIMES + "SELECT fee_tier, " + ", ".join(
    f"round(sum(payout*user_count) FILTER (total_own_band='{b}')/sum(cost*user_count) FILTER (total_own_band='{b}'), 6) AS \"{b}\"" for b in _PIV)
    + " FROM e WHERE fee_tier IS NOT NULL GROUP BY 1")
def _(t):
    e = regime_entries(t).where("fee_tier IS NOT NULL")
    return e.groupBy("fee_tier").pivot("total_own_band", _PIV).agg(
        r6(R.ratio(F.sum(F.col("payout") * F.col("user_count")), F.sum(F.col("cost") * F.col("user_count")))))


@query("G18_best_bucket", REGIMES + """
, r AS (SELECT contest_archetype, total_own_band, sum(payout*user_count)/sum(cost*user_count) AS roi FROM e WHERE total_own_band IS NOT NULL GROUP BY 1, 2)
SELECT contest_archetype, arg_max(total_own_band, roi) AS best_band, round(max(roi), 6) AS best_roi FROM r GROUP BY 1""")
def _(t):
    r = R.weighted_roi(regime_entries(t).where("total_own_band IS NOT NULL"), ["contest_archetype", "total_own_band"])
    return r.groupBy("contest_archetype").agg(F.max_by("total_own_band", "weighted_roi").alias("best_band"), r6(F.max("weighted_roi")).alias("best_roi"))


@query("G19_group_difference", MEMBERS + """
SELECT brand, round(avg(actual_points) FILTER (move_dir = 'steamed') - avg(actual_points) FILTER (move_dir = 'drifted'), 6) + 0.0::DOUBLE AS diff FROM mp GROUP BY 1""")
def _(t):
    side = lambda d: F.avg(F.when(F.col("move_dir") == d, F.col("actual_points")))
    return member_panel(t).groupBy("brand").agg(r6(side("steamed") - side("drifted")).alias("diff"))


@query("G20_regression_aggregates", """
SELECT brand, round(corr(close_prob, actual_points), 6) AS r, round(covar_samp(close_prob, actual_points), 6) AS cov,
       round(regr_slope(actual_points, close_prob), 6) AS slope, round(regr_intercept(actual_points, close_prob), 6) AS intercept FROM players GROUP BY 1""")
def _(t):
    return t.players.groupBy("brand").agg(r6(F.corr("close_prob", "actual_points")).alias("r"), r6(F.covar_samp("close_prob", "actual_points")).alias("cov"),
                                          r6(F.regr_slope("actual_points", "close_prob")).alias("slope"), r6(F.regr_intercept("actual_points", "close_prob")).alias("intercept"))


# ---- order and set operations ------------------------------------------------

@query("O01_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("O02_category_order", REGIMES + f"SELECT total_own_band, list_position({_PIV!r}, total_own_band)::INT - 1 AS ord, count(*) AS n FROM e WHERE total_own_band IS NOT NULL GROUP BY 1, 2 ORDER BY 2")
def _(t):
    e = regime_entries(t).withColumn("ord", B.band_ordinal("total_ownership", P.TOTAL_OWN["edges"]))
    return e.where("total_own_band IS NOT NULL").groupBy("total_own_band", "ord").agg(F.count(F.lit(1)).alias("n")).orderBy("ord")


@query("O04_sort_by_magnitude", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(20)


@query("U01_union_all_sides", """
SELECT l_orderkey AS k, 'ship' AS side, l_shipdate::DATE::VARCHAR AS d FROM lineitem UNION ALL SELECT l_orderkey, 'order', o_orderdate::DATE::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    j = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    s = lambda n, c: F.struct(F.lit(n).alias("side"), F.to_date(c).cast("string").alias("d"))
    return j.select(F.col("l_orderkey").alias("k"), F.explode(F.array(s("ship", "l_shipdate"), s("order", "o_orderdate"))).alias("x")).select("k", "x.*")


@query("U02_union_distinct_names", "SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier")
def _(t):
    return t.part.select(F.col("p_name").alias("name")).union(t.supplier.select("s_name")).distinct()


@query("U04_distinct_dates", "SELECT DISTINCT date_id, day_id FROM contests")
def _(t):
    return t.contests.select("date_id", "day_id").distinct()


@query("U05_date_difference", """
SELECT DISTINCT day_id FROM contests WHERE status = 'F' AND day_id NOT IN (SELECT day_id FROM contests WHERE priority = '1-URGENT')""")
def _(t):
    return t.contests.where("status = 'F'").select("day_id").distinct().join(t.contests.where("priority = '1-URGENT'").select("day_id").distinct(), "day_id", "left_anti")


@query("J02_left_join_two_keys", """
, q AS (SELECT day_id, player_id, max(close_prob) AS p FROM players WHERE open_prob IS NOT NULL GROUP BY 1, 2)
SELECT contest_id, player_id, round(p, 6) AS p FROM players LEFT JOIN q USING (day_id, player_id)""")
def _(t):
    q = t.players.where("open_prob IS NOT NULL").groupBy("day_id", "player_id").agg(r6(F.max("close_prob")).alias("p"))
    return t.players.select("contest_id", "player_id", "day_id").join(q, ["day_id", "player_id"], "left").drop("day_id")


@query("J18_mart_view_join", """
SELECT s_suppkey, r_name, n_parts, round(avg_price, 4) AS avg_price FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1) a ON a.l_suppkey = s_suppkey
LEFT JOIN (SELECT l_suppkey, avg(l_extendedprice) AS avg_price FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON b.l_suppkey = s_suppkey""")
def _(t):
    li = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    a = li.groupBy("s_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"))
    b = li.where("l_returnflag = 'A'").groupBy("s_suppkey").agg(r6(F.avg("l_extendedprice"), 4).alias("avg_price"))
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return s.select("s_suppkey", "r_name").join(a, "s_suppkey", "left").join(b, "s_suppkey", "left")


@query("G04_having", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 15000")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity"), 2).alias("q")).where("q > 15000")


@query("O03_largest_groups", "SELECT player_id, round(sum(actual_points), 2) AS total FROM players GROUP BY 1 ORDER BY total DESC, player_id LIMIT 15")
def _(t):
    return t.players.groupBy("player_id").agg(r6(F.sum("actual_points"), 2).alias("total")).orderBy(F.desc("total"), "player_id").limit(15)


@query("F03_similarity_ratio")
def _(t):
    from ledgerfold.operators.identity import similarity
    d = t.part.select("p_partkey", S.normalize_name("p_name").alias("a"), F.lower("p_brand").alias("b"))
    pairs = d.select("a", "b").distinct().withColumn("ratio", r6(similarity("a", "b")))  # each pair of values once
    return d.join(pairs, ["a", "b"]).select("p_partkey", "ratio")
