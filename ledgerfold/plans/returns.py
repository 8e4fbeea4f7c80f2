"""Weighted-return discovery and inference on the role views (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold import presets as P
from ledgerfold.functions.bands import apply_band
from ledgerfold.operators import inference as I, returns as R
from ledgerfold.plans.registry import query, r6

# ---- oracle fragments ----------------------------------------------------
REGIMES = """
, e AS (
  SELECT *,
   CASE WHEN fight_count > 0 AND fight_count <= 11 THEN 'SHORT' WHEN fight_count <= 13 THEN 'STANDARD'
        WHEN fight_count > 13 THEN 'FULL' END AS slate_size,
   CASE WHEN contest_size > 0 AND contest_size <= 10000 THEN 'small' WHEN contest_size > 0 AND contest_size <= 30000 THEN 'medium'
        WHEN contest_size > 0 AND contest_size <= 50000 THEN 'large' WHEN contest_size > 50000 THEN 'mega' END AS field_size,
   CASE WHEN entry_fee <= 0 THEN NULL WHEN entry_fee <= 3 THEN 'MICRO' WHEN entry_fee <= 8 THEN 'LOW'
        WHEN entry_fee <= 20 THEN 'MID' ELSE 'HIGH' END AS fee_tier,
   CASE WHEN fight_count <= 11 THEN '10-11' WHEN fight_count <= 14 THEN fight_count::VARCHAR ELSE '15+' END AS fight_count_band,
   CASE WHEN multi_entry_max IS NULL THEN 'UNLIMITED' WHEN multi_entry_max = 1 THEN 'SE'
        WHEN multi_entry_max <= 20 THEN 'LIMITED' WHEN multi_entry_max <= 150 THEN '150-Max' ELSE 'UNLIMITED' END AS contest_archetype,
   CASE WHEN contest_name ILIKE '%mini-max%' THEN 'mini-MAX' WHEN contest_name ILIKE '%throwdown%' THEN 'Throwdown'
        WHEN contest_name ILIKE '%arm bar%' THEN 'Arm Bar'
        WHEN contest_name ILIKE '%hook%' AND contest_name NOT ILIKE '%hook &%' THEN 'Hook'
        WHEN contest_name ILIKE '%haymaker%' THEN 'Haymaker' WHEN contest_name ILIKE '%special%' THEN 'Special'
        ELSE 'Other' END AS contest_family,
   CASE WHEN total_ownership <= 0 THEN NULL WHEN total_ownership <= 100 THEN '<100%' WHEN total_ownership <= 125 THEN '100-125%'
        WHEN total_ownership <= 150 THEN '125-150%' WHEN total_ownership <= 175 THEN '150-175%'
        WHEN total_ownership <= 200 THEN '175-200%' ELSE '200%+' END AS total_own_band,
   CASE WHEN 50000-total_salary <= -1 THEN NULL WHEN 50000-total_salary <= 0 THEN '$0 (maxed)'
        WHEN 50000-total_salary <= 500 THEN '$1-500' WHEN 50000-total_salary <= 1000 THEN '$500-1K'
        WHEN 50000-total_salary <= 2000 THEN '$1K-2K' ELSE '$2K+' END AS salary_remaining_band,
   CASE WHEN favorite_count BETWEEN 0 AND 6 THEN favorite_count::VARCHAR END AS fav_count_band,
   CASE WHEN implied_prob_sum <= 0 THEN NULL WHEN implied_prob_sum <= 2.5 THEN '<2.5' WHEN implied_prob_sum <= 2.75 THEN '2.5-2.75'
        WHEN implied_prob_sum <= 3.0 THEN '2.75-3.0' WHEN implied_prob_sum <= 3.25 THEN '3.0-3.25'
        WHEN implied_prob_sum <= 3.5 THEN '3.25-3.5' WHEN implied_prob_sum <= 3.75 THEN '3.5-3.75'
        WHEN implied_prob_sum > 3.75 THEN '3.75+' END AS prob_sum_band,
   CASE WHEN own_prob_ratio <= 0 THEN NULL WHEN own_prob_ratio <= 0.5 THEN '<0.50' WHEN own_prob_ratio <= 0.75 THEN '0.50-0.75'
        WHEN own_prob_ratio <= 1.0 THEN '0.75-1.0' WHEN own_prob_ratio <= 1.25 THEN '1.0-1.25'
        WHEN own_prob_ratio > 1.25 THEN '1.25+' END AS own_prob_band,
   CASE WHEN lineup_count <= 0 THEN NULL WHEN lineup_count <= 1 THEN '1 (unique)' WHEN lineup_count <= 5 THEN '2-5'
        WHEN lineup_count <= 20 THEN '6-20' WHEN lineup_count <= 100 THEN '21-100' ELSE '101+' END AS dupe_band,
   CASE WHEN min_ownership <= 0 OR min_ownership > 100 THEN NULL WHEN min_ownership <= 3 THEN '<3%'
        WHEN min_ownership <= 8 THEN '3-8%' WHEN min_ownership <= 15 THEN '8-15%' ELSE '15%+' END AS min_own_band,
   CASE WHEN max_ownership <= 0 OR max_ownership > 100 THEN NULL WHEN max_ownership <= 25 THEN '<25%'
        WHEN max_ownership <= 35 THEN '25-35%' WHEN max_ownership <= 50 THEN '35-50%' ELSE '50%+' END AS max_own_band,
   tossup_count::INT::VARCHAR AS tossup_label
  FROM entries)
"""
METRICS = """count(*) AS n_lineups, sum(user_count)::BIGINT AS n_entries,
 round(sum(payout*user_count)/sum(cost*user_count), 4) AS weighted_roi,
 round(avg(CASE WHEN lineup_percentile <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS top1pct_rate,
 round(avg(CASE WHEN payout > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS cash_rate"""

HASH = "('0x'||substr(md5({}),1,8))::UBIGINT::BIGINT"


def bootstrap_sql(groups: str, source: str, draws: int, num: str = "payout*user_count", den: str = "cost*user_count",
                  event: str = "date_id", seed: int = 42) -> str:
    """CTEs ending in ``boot`` with the interval of every group of ``source``."""
    return f"""
, es AS (SELECT {groups}, {event} AS ev, sum({num}) AS wp, sum({den}) AS wc, count(*) AS n_rows
         FROM {source} GROUP BY ALL),
rk AS (SELECT {groups}, wp, wc, n_rows, row_number() OVER (PARTITION BY {groups} ORDER BY ev) - 1 AS pos,
       count(*) OVER (PARTITION BY {groups}) AS n_events FROM es),
pt AS (SELECT {groups}, sum(wp)/sum(wc) AS point_estimate, count(*) AS n_events, sum(n_rows)::BIGINT AS n_samples
       FROM rk GROUP BY ALL),
sz AS (SELECT DISTINCT n_events FROM rk),
dr AS (SELECT n_events, b, {HASH.format("'" + str(seed) + "|'||b||'|'||j")} % n_events AS pos, count(*) AS times
       FROM (SELECT n_events, b, unnest(range(n_events)) AS j
             FROM (SELECT n_events, unnest(range({draws})) AS b FROM sz)) GROUP BY ALL),
st AS (SELECT {groups}, b, sum(wp*times)/sum(wc*times) AS x FROM rk JOIN dr USING (n_events, pos) GROUP BY ALL),
sp AS (SELECT {groups}, quantile_cont(x, 0.025) AS ci_lower, quantile_cont(x, 0.975) AS ci_upper, stddev_pop(x) AS std,
       least(1.0::DOUBLE, 2*CASE WHEN avg(x) >= 1 THEN avg((x <= 1)::INT) ELSE avg((x >= 1)::INT) END) AS p_value
       FROM st GROUP BY ALL),
boot AS (SELECT * FROM pt JOIN sp USING ({groups}))
"""


BH = """
, b1 AS (SELECT *, row_number() OVER (ORDER BY p_value, analysis, bucket) AS r, count(*) OVER () AS n FROM boot),
b2 AS (SELECT *, max(CASE WHEN p_value <= r/n*0.1::DOUBLE THEN r END) OVER () AS k FROM b1),
fdr AS (SELECT *, coalesce(r <= k, false) AS survives_fdr FROM b2)
"""

DIM10 = {"total_own_band": "total_own_band", "salary_remaining_band": "salary_remaining_band",
         "fav_count_band": "fav_count_band", "prob_sum_band": "prob_sum_band", "own_prob_band": "own_prob_band",
         "dupe_band": "dupe_band", "contest_family": "contest_family", "slate_size": "slate_size",
         "fee_tier": "fee_tier", "contest_archetype": "contest_archetype"}
LONG10 = ", long AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS analysis, {d} AS bucket, date_id, payout, cost, user_count FROM e WHERE {d} IS NOT NULL"
    for d in DIM10) + ")"

INTERVAL_OUT = """round(point_estimate, 6) AS point_estimate, round(ci_lower, 6) AS ci_lower,
 round(ci_upper, 6) AS ci_upper, round(std, 6) AS std, round(p_value, 6) AS p_value, n_events, n_samples"""
INTERVAL_COLS = ["point_estimate", "ci_lower", "ci_upper", "std", "p_value"]


def interval_out(df, keys, extra=()):
    return df.select(*keys, *[r6(c).alias(c) for c in INTERVAL_COLS], "n_events", "n_samples", *extra)


def regime_entries(t):
    return R.add_regime_columns(t.entries)


# ---- ROI tables ----------------------------------------------------------

REGIME_COLS = ["slate_size", "field_size", "fee_tier", "fight_count_band", "contest_archetype", "contest_family",
               "total_own_band", "salary_remaining_band", "fav_count_band", "prob_sum_band", "own_prob_band",
               "dupe_band", "min_own_band", "max_own_band", "tossup_label"]


@query("D01_regime_columns", REGIMES + f"""
SELECT {', '.join(REGIME_COLS)}, count(*) AS n FROM e GROUP BY ALL""")
def _(t):
    return regime_entries(t).groupBy(*REGIME_COLS).agg(F.count(F.lit(1)).alias("n"))


@query("D02_weighted_roi", """
SELECT date_id, round(sum(payout*user_count)/sum(cost*user_count), 6) AS weighted_roi FROM entries GROUP BY 1""")
def _(t):
    return R.weighted_roi(t.entries, ["date_id"]).select("date_id", r6("weighted_roi").alias("weighted_roi"))


@query("D02_weighted_roi_by_band", REGIMES + f"""
SELECT total_own_band, {METRICS} FROM e WHERE total_own_band IS NOT NULL GROUP BY 1""")
def weighted_roi_by_band(t):
    return R.roi_table(regime_entries(t), ["total_own_band"])


@query("D03_contest_mean_roi", """
, c1 AS (SELECT priority, contest_id, avg(payout) AS p, max(entry_fee) AS c, count(*) AS n FROM entries GROUP BY 1, 2)
SELECT priority, round(sum(CASE WHEN c > 0 THEN p/c*n END)/sum(CASE WHEN c > 0 THEN n END), 6) AS roi,
       sum(n)::BIGINT AS n_lineups FROM c1 GROUP BY 1""")
def _(t):
    return R.contest_mean_roi(t.entries, ["priority"], cost="entry_fee", same_cost=True).select(
        "priority", r6("roi").alias("roi"), "n_lineups")


@query("D04_ratio_of_means", REGIMES + """
SELECT contest_archetype, count(*) AS n_lineups, round(avg(payout)/avg(cost), 6) AS roi FROM e GROUP BY 1""")
def _(t):
    return R.ratio_of_means(regime_entries(t), ["contest_archetype"]).select(
        "contest_archetype", "n_lineups", r6("roi").alias("roi"))


@query("D05_roi_table", REGIMES + f"""
SELECT slate_size, fee_tier, {METRICS} FROM e WHERE slate_size IS NOT NULL AND fee_tier IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return R.roi_table(regime_entries(t), ["slate_size", "fee_tier"])


def _tables_sql(dims):
    return REGIMES + " UNION ALL ".join(
        f"""SELECT '{a}' AS analysis, concat_ws(' / ', {', '.join(ks)}) AS bucket, {METRICS} FROM e
            WHERE {' AND '.join(k + ' IS NOT NULL' for k in ks)} GROUP BY ALL""" for a, ks in dims.items())


@query("D06_one_dimensional_tables", _tables_sql(R.ONE_DIM))
def _(t):
    return R.roi_tables(regime_entries(t), R.ONE_DIM)


@query("D07_cross_tabs", _tables_sql(R.CROSS_TABS))
def _(t):
    return R.roi_tables(regime_entries(t), R.CROSS_TABS)


@query("D08_discovery_run_all", _tables_sql({**R.ONE_DIM, **R.CROSS_TABS}))
def _(t):
    return R.discovery(t.entries)


STUDY = {
    "total_ownership": ("total_ownership", P.TOTAL_OWN),
    "salary_remaining": ("50000 - total_salary", P.STUDY_SALARY_REMAINING),
    "salary_spread": ("salary_spread", P.STUDY_SALARY_SPREAD),
    "min_ownership": ("min_ownership", P.STUDY_MIN_OWN),
    "max_ownership": ("max_ownership", P.STUDY_MAX_OWN),
    "duplication": ("lineup_count", P.DUPLICATION),
    "favorite_count": ("favorite_count", P.FAV_COUNT),
}


def case_sql(expr, spec):
    """The SQL twin of a band preset, written from the same edge table."""
    inf = float("inf")
    right = spec.get("closed", "right") == "right"
    parts = []
    for lo, hi, label in zip(spec["edges"], spec["edges"][1:], spec["labels"]):
        low = "TRUE" if lo == -inf else f"{expr} {'>' if right else '>='} {lo}::DOUBLE"
        if spec.get("include_lowest") and lo == spec["edges"][0]:
            low = f"{expr} >= {lo}::DOUBLE"
        high = "TRUE" if hi == inf else f"{expr} {'<=' if right else '<'} {hi}::DOUBLE"
        safe = label.replace("'", "''")
        parts.append(f"WHEN {low} AND {high} THEN '{safe}'")
    return "CASE " + " ".join(parts) + " END"


ARCH_B = """CASE WHEN multi_entry_max = 1 THEN 'SE' WHEN multi_entry_max BETWEEN 3 AND 18 THEN 'LIMITED'
 WHEN multi_entry_max = 20 THEN '20-Max' WHEN multi_entry_max = 150 THEN '150-Max' ELSE 'UNLIMITED' END"""
_STUDY_SQL_COL = {"salary_remaining": "(50000-total_salary)", "duplication": "lineup_count"}
STUDY_LONG = f"""
, hs AS (SELECT contest_id, count(*) FILTER (salary >= {P.HIGH_SALARY}) AS high_salary_count FROM players GROUP BY 1),
s AS (SELECT *, {ARCH_B} AS arch FROM entries LEFT JOIN hs USING (contest_id)), l AS (""" + " UNION ALL ".join(
    f"SELECT arch, '{n}' AS analysis, {case_sql(_STUDY_SQL_COL.get(n, n), spec)} AS bucket, contest_id, payout, entry_fee, points, cost FROM s"
    for n, (_, spec) in STUDY.items()) + """
 UNION ALL SELECT arch, 'high_salary_count', high_salary_count::VARCHAR, contest_id, payout, entry_fee, points, cost FROM s)"""


@query("D09_roi_by_band_per_archetype", STUDY_LONG + """
, c1 AS (SELECT arch, analysis, bucket, contest_id, avg(payout) AS p, max(entry_fee) AS c, count(*) AS n,
         sum((payout > cost)::INT) AS cashed, sum(points) AS pts FROM l WHERE bucket IS NOT NULL GROUP BY ALL)
SELECT arch, analysis, bucket, round(sum(CASE WHEN c > 0 THEN p/c*n END)/sum(CASE WHEN c > 0 THEN n END), 4) AS roi,
       sum(n)::BIGINT AS n_lineups, round(sum(cashed)/sum(n), 4) AS cash_rate, round(sum(pts)/sum(n), 2) AS avg_points
FROM c1 GROUP BY ALL""")
def _(t):
    dear = t.players.groupBy("contest_id").agg(F.count_if(F.col("salary") >= P.HIGH_SALARY).cast("string").alias("_b_high_salary_count"))
    e = t.entries.withColumn("arch", R.archetype(taxonomy="study")).join(dear, "contest_id", "left")
    e = e.withColumns({f"_b_{n}": apply_band(F.expr(x), spec) for n, (x, spec) in STUDY.items()})
    long = I.unpivot_dims(e, {n: f"_b_{n}" for n in [*STUDY, "high_salary_count"]}, ["arch", "contest_id", "payout", "entry_fee", "points", "cost"])
    out = R.contest_mean_roi(long, ["arch", "analysis", "bucket"], cost="entry_fee", same_cost=True, extra=[
        F.sum((F.col("payout") > F.col("cost")).cast("long")).alias("cashed"), F.sum("points").alias("pts")])
    return out.select("arch", "analysis", "bucket", r6("roi", 4).alias("roi"), "n_lineups",
                      r6(F.col("cashed") / F.col("n_lineups"), 4).alias("cash_rate"),
                      r6(F.col("pts") / F.col("n_lineups"), 2).alias("avg_points"))


EFF_SQL = case_sql("eff", P.EFFECTIVE_ENTRIES)
FEE_SQL = case_sql("entry_fee", P.STUDY_FEE)
FIELD_SQL = case_sql("contest_size", P.STUDY_FIELD)


@query("D10_unlimited_splits", f"""
, s AS (SELECT *, {ARCH_B} AS arch, {FEE_SQL} AS fee, {FIELD_SQL} AS field FROM entries),
l AS (SELECT 'fee' AS split, fee AS bucket, contest_id, payout, entry_fee FROM s WHERE arch = 'UNLIMITED'
      UNION ALL SELECT 'field', field, contest_id, payout, entry_fee FROM s WHERE arch = 'UNLIMITED'),
c1 AS (SELECT split, bucket, contest_id, avg(payout) AS p, max(entry_fee) AS c, count(*) AS n FROM l GROUP BY ALL)
SELECT split, bucket, round(sum(CASE WHEN c > 0 THEN p/c*n END)/sum(CASE WHEN c > 0 THEN n END), 6) AS roi,
       sum(n)::BIGINT AS n_lineups FROM c1 GROUP BY ALL""")
def _(t):
    e = t.entries.where(R.archetype(taxonomy="study") == "UNLIMITED")
    long = e.select("contest_id", "payout", "entry_fee", F.explode(F.array(
        F.struct(F.lit("fee").alias("split"), apply_band("entry_fee", P.STUDY_FEE).alias("bucket")),
        F.struct(F.lit("field").alias("split"), apply_band("contest_size", P.STUDY_FIELD).alias("bucket")))).alias("d")
    ).select("d.*", "contest_id", "payout", "entry_fee")
    return R.contest_mean_roi(long, ["split", "bucket"], cost="entry_fee", same_cost=True).select(
        "split", "bucket", r6("roi").alias("roi"), "n_lineups")


OWN_COLUMNS = dict(zip(P.TOTAL_OWN["labels"], ["lt100", "100_125", "125_150", "150_175", "175_200", "200_up"]))
_OWN_NO = "CASE total_own_band " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(OWN_COLUMNS)) + " END"


@query("D10_effective_entries_cross_tab", REGIMES + f"""
, f AS (SELECT *, least(coalesce(multi_entry_max, 999), contest_size)/contest_size AS eff FROM e WHERE contest_size > 0),
k AS (SELECT {EFF_SQL} AS eff_band, total_own_band, payout, cost, points FROM f),
g AS (SELECT eff_band, total_own_band, count(*) AS n, CASE WHEN count(*) >= 10 THEN CASE WHEN avg(cost) > 0 THEN avg(payout)/avg(cost) ELSE 0 END END AS roi
      FROM k WHERE eff_band IS NOT NULL AND total_own_band IS NOT NULL GROUP BY 1, 2),
w AS (SELECT eff_band, """ + ", ".join(
    f"round(max(roi) FILTER (total_own_band = '{b}'), 6) AS own_{c}, coalesce(max(n) FILTER (total_own_band = '{b}'), 0) AS n_{c}" for b, c in OWN_COLUMNS.items()) + f""",
       arg_max(total_own_band, {{'r': roi, 'o': -({_OWN_NO})}}) FILTER (roi IS NOT NULL) AS best_band FROM g GROUP BY 1),
a AS (SELECT eff_band, count(*) AS n_lineups, round(CASE WHEN avg(cost) > 0 THEN avg(payout)/avg(cost) ELSE 0 END, 6) AS roi, round(100*avg((payout > cost)::INT), 4) AS cash_pct,
      round(avg(points), 4) AS avg_points FROM k WHERE eff_band IS NOT NULL GROUP BY 1)
SELECT * FROM a LEFT JOIN w USING (eff_band)""")
def _(t):
    e = regime_entries(t).withColumn("eff_band", apply_band(R.effective_entries(), P.EFFECTIVE_ENTRIES)).where("eff_band IS NOT NULL")
    # one pass: partial sums per cell serve the cells and the band totals
    cells = e.groupBy("eff_band", "total_own_band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payout").alias("p"), F.sum("cost").alias("c"), F.sum("points").alias("pts"), F.count("points").alias("np"),
        F.count_if(F.col("payout") > F.col("cost")).alias("cashed"))
    roi = lambda p, c: F.when(c > 0, p / c).otherwise(0.0)
    cells = cells.withColumn("roi", F.when(F.col("total_own_band").isNotNull() & (F.col("n") >= 10), roi(F.col("p"), F.col("c"))))
    place = F.array_position(F.array(*[F.lit(b) for b in OWN_COLUMNS]), F.col("total_own_band"))
    at = lambda b, v: F.max(F.when(F.col("total_own_band") == b, F.col(v)))
    best = F.max_by("total_own_band", F.when(F.col("roi").isNotNull(), F.struct("roi", (-place).alias("o"))))
    return cells.groupBy("eff_band").agg(
        F.sum("n").alias("n_lineups"), r6(roi(F.sum("p"), F.sum("c"))).alias("roi"), r6(100 * F.sum("cashed") / F.sum("n"), 4).alias("cash_pct"),
        r6(F.sum("pts") / F.sum("np"), 4).alias("avg_points"), best.alias("best_band"),
        *[x for b, c in OWN_COLUMNS.items() for x in (r6(at(b, "roi")).alias(f"own_{c}"), F.coalesce(at(b, "n"), F.lit(0)).alias(f"n_{c}"))])


@query("D11_scoring_thresholds", """
, s AS (SELECT *, """ + ARCH_B + """ AS arch FROM entries),
r AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY points DESC, price DESC, part_id, supp_id, line_no, ship_date) AS rk,
      count(*) OVER (PARTITION BY contest_id) AS n FROM s),
c AS (SELECT arch, contest_id, sum(points) AS pts, max(n) AS n, max(CASE WHEN rk = 1 THEN points END) AS win,
      max(CASE WHEN rk = least(cash_line, n) AND cash_line IS NOT NULL THEN points END) AS cash,
      max(CASE WHEN rk = greatest(1, floor(n*0.05::DOUBLE)) THEN points END) AS t5,
      max(CASE WHEN rk = greatest(1, floor(n*0.01::DOUBLE)) THEN points END) AS t1 FROM r GROUP BY 1, 2)
SELECT arch, round(sum(pts)/sum(n), 4) AS avg_points, round(avg(cash), 4) AS cash_line_points,
       round(avg(t5), 4) AS top_5pct_points, round(avg(t1), 4) AS top_1pct_points, round(avg(win), 4) AS winner_points,
       count(*) AS n_contests FROM c GROUP BY 1""")
def _(t):
    e = t.entries.withColumn("arch", R.archetype(taxonomy="study"))
    cols = {"top_5pct_points": 0.05, "top_1pct_points": 0.01}
    e = e.select("arch", "contest_id", "points", "cash_line", "price", "part_id", "supp_id", "line_no", "ship_date")
    out = R.scoring_thresholds(e, ["arch"], order=["-points", "-price", "part_id", "supp_id", "line_no", "ship_date"],
                               fractions=cols)
    return out.select("arch", *[r6(c, 4).alias(c) for c in
                                ["avg_points", "cash_line_points", *cols, "winner_points"]], "n_contests")


# ---- inference -----------------------------------------------------------

@query("G15_event_partial_sums", REGIMES + """
SELECT total_own_band, date_id, round(sum(payout*user_count), 4) AS wp, round(sum(cost*user_count), 4) AS wc,
       count(*) AS n_rows FROM e GROUP BY 1, 2""")
def _(t):
    s = I.event_sums(regime_entries(t), ["total_own_band"], "date_id",
                     {"wp": F.col("payout") * F.col("user_count"), "wc": F.col("cost") * F.col("user_count")})
    return s.select("total_own_band", "date_id", r6("wp", 4).alias("wp"), r6("wc", 4).alias("wc"), "n_rows")


@query("D17_bootstrap_ci", ", all_rows AS (SELECT 1 AS one, * FROM entries)"
       + bootstrap_sql("one", "all_rows", 2000) + f"SELECT {INTERVAL_OUT} FROM boot")
def _(t):
    return interval_out(I.roi_interval(t.entries, []), [])


@query("D18_bootstrap_p_value", REGIMES + bootstrap_sql("fee_tier", "(SELECT * FROM e WHERE fee_tier IS NOT NULL)", 2000)
       + "SELECT fee_tier, round(p_value, 6) AS p_value FROM boot")
def _(t):
    e = regime_entries(t).where("fee_tier IS NOT NULL")
    return I.roi_interval(e, ["fee_tier"]).select("fee_tier", r6("p_value").alias("p_value"))


@query("D19_grouped_bootstrap", REGIMES
       + bootstrap_sql("total_own_band", "(SELECT * FROM e WHERE total_own_band IS NOT NULL)", 2000)
       + f"SELECT total_own_band, {INTERVAL_OUT} FROM boot")
def _(t):
    e = regime_entries(t).where("total_own_band IS NOT NULL")
    return interval_out(I.roi_interval(e, ["total_own_band"]), ["total_own_band"])


@query("D20_all_dimension_ci", REGIMES + LONG10 + bootstrap_sql("analysis, bucket", "long", 2000) + BH
       + f"SELECT analysis, bucket, {INTERVAL_OUT}, survives_fdr FROM fdr")
def all_dimension_ci(t):
    return interval_out(I.all_dimension_intervals(regime_entries(t), DIM10), ["analysis", "bucket"], ["survives_fdr"])


@query("D21_fdr_summary", REGIMES + LONG10 + bootstrap_sql("analysis, bucket", "long", 2000) + BH + """
SELECT count(*) AS total_tests, sum(survives_fdr::INT)::BIGINT AS surviving, sum((NOT survives_fdr)::INT)::BIGINT AS rejected,
       0.1::DOUBLE AS q, round(min(p_value), 6) AS min_p,
       round(max(CASE WHEN survives_fdr THEN p_value END), 6) AS max_surviving_p FROM fdr""")
def _(t):
    ci = I.all_dimension_intervals(regime_entries(t), DIM10, draws=2000)
    s = I.fdr_summary(ci)
    return s.select("total_tests", "surviving", "rejected", "q", r6("min_p").alias("min_p"),
                    r6("max_surviving_p").alias("max_surviving_p"))


SPLIT = """
, ev AS (SELECT date_id, row_number() OVER (ORDER BY date_id) AS no, count(*) OVER () AS n
         FROM (SELECT DISTINCT date_id FROM entries)),
per AS (SELECT date_id, CASE WHEN no <= floor(n*0.6::DOUBLE) THEN 'train' ELSE 'test' END AS period FROM ev)
"""


@query("D22_chronological_split", SPLIT + """
SELECT period, count(DISTINCT date_id) AS n_dates, count(*) AS n_rows, min(date_id) AS first_date, max(date_id) AS last_date
FROM entries JOIN per USING (date_id) GROUP BY 1""")
def _(t):
    s = I.chronological_split(t.entries)
    return s.groupBy("period").agg(F.countDistinct("date_id").alias("n_dates"), F.count(F.lit(1)).alias("n_rows"),
                                   F.min("date_id").alias("first_date"), F.max("date_id").alias("last_date"))


_RULE_ROWS = ", ".join(f"('{d}', '{b}')" for d, b in P.PRIORITY_RULES)
_RULES = " OR ".join(f"(analysis = '{d}' AND bucket = '{b}')" for d, b in P.PRIORITY_RULES)


@query("D23_rule_validation", REGIMES + LONG10 + SPLIT
       + f", lp AS (SELECT * FROM long JOIN per USING (date_id) WHERE {_RULES})"
       + bootstrap_sql("analysis, bucket, period", "lp", 2000) + """
SELECT analysis, bucket,
 round(max(point_estimate) FILTER (period='train' AND n_samples >= 100), 6) AS train_roi,
 round(max(ci_lower) FILTER (period='train' AND n_samples >= 100), 6) AS train_ci_lower,
 round(max(point_estimate) FILTER (period='test' AND n_samples >= 100), 6) AS test_roi,
 round(max(ci_lower) FILTER (period='test' AND n_samples >= 100), 6) AS test_ci_lower,
 round(coalesce(max(p_value) FILTER (period='train' AND n_samples >= 100), 1), 6) AS train_p_value,
 coalesce(max(n_samples) FILTER (period='train'), 0) AS train_n, coalesce(max(n_samples) FILTER (period='test'), 0) AS test_n,
 coalesce(max(ci_lower) FILTER (period='train' AND n_samples >= 100) > 1, false)
   AND coalesce(max(ci_lower) FILTER (period='test' AND n_samples >= 100) > 1, false) AS holds
FROM (SELECT * FROM (VALUES """ + _RULE_ROWS + """) v(analysis, bucket)) rules LEFT JOIN boot USING (analysis, bucket) GROUP BY 1, 2""")
def _(t):
    v = I.validate_rules(regime_entries(t), P.PRIORITY_RULES, draws=2000)
    return v.select("analysis", "bucket", *[r6(c).alias(c) for c in
                    ["train_roi", "train_ci_lower", "test_roi", "test_ci_lower", "train_p_value"]],
                    "train_n", "test_n", "holds")


@query("D24_overview", """
SELECT count(*) AS n_lineups, sum(user_count)::BIGINT AS n_entries,
       round(sum(payout*user_count)/sum(cost*user_count), 6) AS weighted_roi, count(DISTINCT contest_id) AS n_contests,
       min(date_id) AS first_date, max(date_id) AS last_date FROM entries""")
def _(t):
    e = t.entries
    return e.agg(F.count(F.lit(1)).alias("n_lineups"), F.sum("user_count").cast("long").alias("n_entries"),
                 r6(R.ratio(F.sum(F.col("payout") * F.col("user_count")), F.sum(F.col("cost") * F.col("user_count"))))
                 .alias("weighted_roi"), F.countDistinct("contest_id").alias("n_contests"),
                 F.min("date_id").alias("first_date"), F.max("date_id").alias("last_date"))
