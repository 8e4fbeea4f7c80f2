"""Point-in-time features, encodings and scalar functions (W*, F*, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold import presets as P
from ledgerfold.functions import bands as B, scalars as S
from ledgerfold.operators import encode as N, ordered as O, returns as R, windows as W
from ledgerfold.plans.registry import query, r6
from ledgerfold.plans.returns import case_sql
from ledgerfold.plans.roles import players_table
from ledgerfold.session import discard

PANEL = """
, pan AS (SELECT player_id, date_id, avg(ownership) AS own, avg(actual_points) AS pts, min(contest_date) AS ts
          FROM players GROUP BY 1, 2)
"""


def line():
    """Window over the (player, date) panel."""
    return W.timeline(["player_id"], "date_id")


def panel(t):
    return t.players.groupBy("player_id", "date_id").agg(
        F.avg("ownership").alias("own"), F.avg("actual_points").alias("pts"), F.min("contest_date").alias("ts"))


def rounded(df, keys, cols, digits=6):
    return df.select(*keys, *[r6(c, digits).alias(c) for c in cols])


_K = ["player_id", "date_id"]
_W = "OVER (PARTITION BY player_id ORDER BY date_id)"


@query("W01_lag_features", PANEL + f"""
SELECT player_id, date_id, round(lag(own, 1) {_W}, 6) AS own_lag1, round(lag(own, 2) {_W}, 6) AS own_lag2,
       round(coalesce(lag(pts, 1) {_W}, 0), 6) AS pts_lag1 FROM pan""")
def _(t):
    d = W.lags(panel(t), ["own"], [1, 2], line())
    return rounded(W.lags(d, ["pts"], [1], line(), fill=0.0), _K, ["own_lag1", "own_lag2", "pts_lag1"])


_R3 = "OVER (PARTITION BY player_id ORDER BY date_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
_R5 = "OVER (PARTITION BY player_id ORDER BY date_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_RX = "OVER (PARTITION BY player_id ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("W02_rolling_features", PANEL + f"""
SELECT player_id, date_id, round(avg(own) {_R3}, 6) AS own_roll3_mean, round(max(own) {_R3}, 6) AS own_roll3_max,
       round(quantile_cont(own, 0.5) {_R3}, 6) AS own_roll3_median,
       CASE WHEN count(pts) {_R5} >= 2 THEN round(stddev_samp(pts) {_R5}, 6) END AS pts_roll5_std,
       CASE WHEN count(pts) {_R5} >= 2 THEN round(sum(pts) {_R5}, 6) END AS pts_roll5_sum FROM pan""")
def _(t):
    d = W.rolling(panel(t), ["own"], [3], line(), aggs=("mean", "max", "median"))
    d = W.rolling(d, ["pts"], [5], line(), aggs=("std", "sum"), min_periods=2)
    return rounded(d, _K, ["own_roll3_mean", "own_roll3_max", "own_roll3_median", "pts_roll5_std", "pts_roll5_sum"])


@query("W03_expanding_features", PANEL + f"""
SELECT player_id, date_id, round(avg(own) {_RX}, 6) AS own_exp_mean, round(min(pts) {_RX}, 6) AS pts_exp_min,
       round(max(pts) {_RX}, 6) AS pts_exp_max FROM pan""")
def _(t):
    d = W.expanding(W.expanding(panel(t), ["own"], line()), ["pts"], line(), aggs=("min", "max"))
    return rounded(d, _K, ["own_exp_mean", "pts_exp_min", "pts_exp_max"])


@query("W04_diff", PANEL + f"""
SELECT player_id, date_id, round(pts - lag(pts, 1) {_W}, 6) AS pts_diff1, round(pts - lag(pts, 3) {_W}, 6) AS pts_diff3 FROM pan""")
def _(t):
    return rounded(W.diffs(panel(t), ["pts"], [1, 3], line()), _K, ["pts_diff1", "pts_diff3"])


@query("W05_pct_change", PANEL + f"""
SELECT player_id, date_id, CASE WHEN lag(own) {_W} <> 0 THEN round((own - lag(own) {_W})/lag(own) {_W}, 6) + 0.0::DOUBLE END AS own_pct1
FROM pan""")
def _(t):
    return rounded(W.pct_changes(panel(t), ["own"], [1], line()), _K, ["own_pct1"])


@query("W06_prior_row_count", """
SELECT player_id, contest_id, row_number() OVER (PARTITION BY player_id ORDER BY date_id, contest_id) - 1 AS n_prior
FROM players""")
def _(t):
    n = O.running(t.players.select("player_id", "date_id", "contest_id"), ["player_id"], ["date_id", "contest_id"], number="rn")
    return n.select("player_id", "contest_id", (F.col("rn") - 1).alias("n_prior"))


@query("W07_days_since_previous", PANEL + f"""
SELECT player_id, date_id, floor((epoch(ts) - epoch(lag(ts) {_W}))/86400)::BIGINT AS days_since_last,
       (row_number() {_W} - 1)::INT AS n_prior FROM pan""")
def _(t):
    return W.recency(panel(t), "ts", line()).select(*_K, "days_since_last", F.col("n_prior").cast("int").alias("n_prior"))


@query("W01_row_grain_lags", """
SELECT player_id, contest_id, round(lag(ownership, 1) OVER w, 6) AS ownership_lag1,
       round(lag(ownership, 2) OVER w, 6) AS ownership_lag2 FROM players
WINDOW w AS (PARTITION BY player_id ORDER BY date_id, contest_id)""")
def _(t):
    d = W.row_lags(t.players.select("player_id", "date_id", "contest_id", "ownership"), ["player_id"],
                   ["date_id", "contest_id"], "ownership", [1, 2])
    return rounded(d, ["player_id", "contest_id"], ["ownership_lag1", "ownership_lag2"])


@query("W03_row_grain_expanding", """
SELECT player_id, contest_id, round(avg(actual_points) OVER (PARTITION BY player_id ORDER BY date_id, contest_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS actual_points_exp_mean FROM players""")
def _(t):
    d = W.row_expanding_mean(t.players.select("player_id", "date_id", "contest_id", "actual_points"), ["player_id"],
                             ["date_id", "contest_id"], "actual_points")
    return rounded(d, ["player_id", "contest_id"], ["actual_points_exp_mean"], 9)


@query("W08_ranks", """
SELECT player_id, contest_id, rank() OVER (PARTITION BY contest_id ORDER BY salary DESC) AS rank_min,
       round((rank() OVER (PARTITION BY date_id ORDER BY ownership)
              + (count(*) OVER (PARTITION BY date_id, ownership) - 1)/2)/count(*) OVER (PARTITION BY date_id), 6) AS own_pct,
       row_number() OVER (PARTITION BY date_id ORDER BY salary DESC, player_id, contest_id) AS rank_first
FROM players""")
def _(t):
    d = t.players.select("player_id", "contest_id", "date_id", "salary", "ownership")
    d = O.ranks(d, ["contest_id"], "salary", name="rank_min", descending=True)
    d = O.ranks(d, ["date_id"], "ownership", name="own_pct", method="pct")
    d = O.running(d, ["date_id"], ["-salary", "player_id", "contest_id"], number="rank_first")
    return d.select("player_id", "contest_id", "rank_min", r6("own_pct").alias("own_pct"), "rank_first")


@query("W09_event_percentiles", """
, q AS (SELECT date_id, quantile_cont(actual_points, 0.5) AS med, quantile_cont(actual_points, 0.75) AS p75
        FROM players GROUP BY 1)
SELECT date_id, round(any_value(med), 6) AS med, round(any_value(p75), 6) AS p75,
       round(avg((actual_points > med)::INT), 6) AS beat_median, round(avg((actual_points >= p75)::INT), 6) AS top_quartile,
       round(avg((actual_points > med)::INT - close_prob), 6) AS outscore_gap
FROM players JOIN q USING (date_id) GROUP BY 1""")
def _(t):
    d = O.with_percentiles(t.players, ["date_id"], "actual_points", {"med": 0.5, "p75": 0.75})
    beat = F.col("actual_points") > F.col("med")
    return d.groupBy("date_id").agg(
        r6(F.max("med")).alias("med"), r6(F.max("p75")).alias("p75"), r6(B.rate(beat)).alias("beat_median"),
        r6(B.rate(F.col("actual_points") >= F.col("p75"))).alias("top_quartile"),
        r6(F.avg(beat.cast("double") - F.col("close_prob"))).alias("outscore_gap"))


@query("W10_distinct_in_slate", """
SELECT player_id, contest_id, n AS n_on_slate FROM players
JOIN (SELECT date_id, count(DISTINCT player_id) AS n FROM players GROUP BY 1) USING (date_id)""")
def _(t):
    return W.distinct_per_group(t.players, ["date_id"], "player_id", "n_on_slate").select(
        "player_id", "contest_id", "n_on_slate")


@query("W11_equity_curve", """
, d AS (SELECT priority, date_id, contest_id, sum(payout - cost) AS pnl FROM entries GROUP BY 1, 2, 3),
q AS (SELECT *, sum(pnl) OVER (PARTITION BY priority ORDER BY date_id, contest_id) AS eq FROM d),
k AS (SELECT *, max(eq) OVER (PARTITION BY priority ORDER BY date_id, contest_id) AS pk FROM q)
SELECT priority, contest_id, round(eq, 4) AS equity, round(pk - eq, 4) AS drawdown FROM k""")
def _(t):
    d = t.entries.groupBy("priority", "date_id", "contest_id").agg(F.sum(F.col("payout") - F.col("cost")).alias("pnl"))
    e = W.equity_curve(d, ["priority"], ["date_id", "contest_id"], "pnl")
    return rounded(e, ["priority", "contest_id"], ["equity", "drawdown"], 4)


@query("W12_zscore", """
, m AS (SELECT date_id, avg(actual_points) AS mu, stddev_pop(actual_points) AS sd FROM players GROUP BY 1)
SELECT player_id, contest_id, CASE WHEN sd <> 0 THEN round((actual_points - mu)/sd, 6) END AS z
FROM players JOIN m USING (date_id)""")
def _(t):
    return rounded(W.group_zscore(t.players, ["date_id"], "actual_points", "z"), ["player_id", "contest_id"], ["z"])


@query("W13_keep_first", """
SELECT player_id, date_id, contest_id, salary FROM players
QUALIFY row_number() OVER (PARTITION BY player_id, date_id ORDER BY contest_size DESC, contest_id) = 1""")
def _(t):
    p = t.players.select("player_id", "date_id", "contest_id", "salary", "contest_size")
    return W.keep_first(p, ["player_id", "date_id"], ["-contest_size", "contest_id"]).select(
        "player_id", "date_id", "contest_id", "salary")


def _ffd_case(d, thr, col="own"):
    ws = W.ffd_weights(d, thr)
    m = len(ws)
    terms = " + ".join(f"{w!r}::DOUBLE * lag({col}, {k}) OVER w" for k, w in enumerate(ws))
    return m, f"CASE WHEN row_number() OVER w >= {m} THEN {terms} END"


@query("W15_fractional_difference", PANEL + f"""
SELECT player_id, date_id, round({_ffd_case(0.4, 0.02)[1]}, 6) AS own_fd FROM pan
WINDOW w AS (PARTITION BY player_id ORDER BY date_id)""")
def _(t):
    return rounded(W.frac_diff(panel(t), "own", line(), 0.4, 0.02), _K, ["own_fd"])


def daily(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").agg(F.avg("value").alias("v"))


_GRID = [i / 10 for i in range(11)]


def _adf_sql(i):
    return f"""SELECT user_id, {_GRID[i]}::DOUBLE AS d, day, {_ffd_case(_GRID[i], 0.1, 'v')[1]} AS x FROM dl
               WINDOW w AS (PARTITION BY user_id ORDER BY day)"""


@query("W16_minimum_stationary_order", """
, dl AS (SELECT user_id, ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1, 2),
lg AS (""" + " UNION ALL ".join(_adf_sql(i) for i in range(len(_GRID))) + """),
a1 AS (SELECT *, lag(x) OVER w AS x1, x - lag(x) OVER w AS z FROM lg WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id, d ORDER BY day)),
a2 AS (SELECT *, lag(z) OVER (PARTITION BY user_id, d ORDER BY day) AS x2 FROM a1),
s AS (SELECT user_id, d, count(*) AS n, covar_pop(x1,x1)*count(*) AS s11, covar_pop(x2,x2)*count(*) AS s22,
      covar_pop(x1,x2)*count(*) AS s12, covar_pop(x1,z)*count(*) AS s1z, covar_pop(x2,z)*count(*) AS s2z,
      covar_pop(z,z)*count(*) AS szz FROM a2 WHERE x2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 8),
b AS (SELECT *, (s1z*s22 - s2z*s12)/(s11*s22-s12*s12) AS b1, (s2z*s11 - s1z*s12)/(s11*s22-s12*s12) AS b2 FROM s WHERE n > 3),
v AS (SELECT *, (szz - b1*s1z - b2*s2z)/(n-3) AS s2 FROM b),
t AS (SELECT *, CASE WHEN s2 > 0 THEN b1/sqrt(s2*s22/(s11*s22-s12*s12)) END AS t FROM v)
SELECT u.user_id, coalesce(min(CASE WHEN t < -2.86 THEN d END), 1.0::DOUBLE) AS min_d, count(t.user_id) AS n_orders_tested FROM (SELECT DISTINCT user_id FROM dl) u LEFT JOIN t ON t.user_id = u.user_id GROUP BY 1""")
def _(t):
    return W.min_stationary_order(daily(t), ["user_id"], "day", "v", _GRID, threshold=0.1)


@query("W17_card_position", """
, d AS (SELECT date_id, player_id, max(salary) AS salary FROM players GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY date_id ORDER BY salary DESC, player_id) AS card_position FROM d)
SELECT date_id, player_id, card_position, CASE WHEN card_position = 1 THEN 'main_event' WHEN card_position = 2 THEN 'co_main'
  WHEN card_position <= 5 THEN 'main_card' ELSE 'prelim' END AS card_section FROM r""")
def _(t):
    d = t.players.groupBy("date_id", "player_id").agg(F.max("salary").alias("salary"))
    return W.position_in_group(d, ["date_id"], ["-salary", "player_id"], name="card_position",
                               labels=P.CARD_SECTIONS, default=P.CARD_DEFAULT, label_name="card_section").select(
        "date_id", "player_id", "card_position", "card_section")


# ---- encodings and feature sets -------------------------------------------

@query("C01_ownership_features", """
, q AS (SELECT date_id, avg((open_prob IS NOT NULL)::INT) >= 0.8::DOUBLE AS good FROM players GROUP BY 1),
pan AS (SELECT player_id, date_id, avg(ownership) AS own, min(contest_date) AS ts FROM players GROUP BY 1, 2),
h AS (SELECT player_id, date_id, lag(own) OVER w AS l1, lag(own, 2) OVER w AS l2,
      avg(own) OVER (PARTITION BY player_id ORDER BY date_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r3,
      avg(own) OVER (PARTITION BY player_id ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ex,
      floor((epoch(ts) - epoch(lag(ts) OVER w))/86400)::BIGINT AS gap, (row_number() OVER w - 1)::INT AS np
      FROM pan WINDOW w AS (PARTITION BY player_id ORDER BY date_id)),
cp AS (SELECT date_id, player_id, row_number() OVER (PARTITION BY date_id ORDER BY salary DESC, player_id) AS pos
       FROM (SELECT date_id, player_id, max(salary) AS salary FROM players GROUP BY 1, 2))
SELECT player_id, contest_id, date_id, salary, pos AS card_position, contest_size, entry_fee AS entry_cost, round(salary/50000, 6) AS salary_pct,
  rank() OVER (PARTITION BY contest_id ORDER BY salary DESC) AS salary_rank_overall,
  """ + case_sql("salary", P.SALARY_TIER) + """ AS salary_tier,
  CASE WHEN pos = 1 THEN 'main_event' WHEN pos = 2 THEN 'co_main' WHEN pos <= 5 THEN 'main_card' ELSE 'prelim' END AS card_section,
  round(l1, 6) AS ownership_lag1, round(l2, 6) AS ownership_lag2, round(r3, 6) AS ownership_roll3,
  round(ex, 6) AS historical_avg_ownership, gap AS days_since_last, np AS n_prior,
  round(ln(1 + contest_size), 6) AS log_field_size, count(*) OVER (PARTITION BY contest_id) AS num_on_slate,
  CASE WHEN good THEN round(close_prob, 6) END AS consensus_prob, CASE WHEN good THEN (close_prob > 0.5)::INT END AS is_favorite,
  round(ownership, 6) AS target
FROM players JOIN q USING (date_id) JOIN h USING (player_id, date_id) JOIN cp USING (player_id, date_id)""")
def ownership_features(t):
    members = players_table(t, "player_id", "contest_id", "date_id", "contest_date", "salary", "ownership", "close_prob", "open_prob", "contest_size", "entry_fee")
    f = N.ownership_features(members)
    discard(members)
    return f.select("player_id", "contest_id", "date_id", "salary", "card_position", "contest_size", "entry_cost", r6("salary_pct").alias("salary_pct"), "salary_rank_overall",
                    "salary_tier", "card_section", *[r6(c).alias(c) for c in (
                        "ownership_lag1", "ownership_lag2", "ownership_roll3", "historical_avg_ownership")],
                    "days_since_last", "n_prior", r6("log_field_size").alias("log_field_size"), "num_on_slate",
                    r6("consensus_prob").alias("consensus_prob"), "is_favorite", r6("target").alias("target"))


@query("C02_target_encoding", """
, per AS (SELECT *, date_id <= 19971231 AS train FROM players),
g AS (SELECT avg(actual_points) AS g FROM per WHERE train),
s AS (SELECT brand, count(actual_points) AS n, avg(actual_points) AS m FROM per WHERE train GROUP BY 1)
SELECT player_id, contest_id, round(CASE WHEN n >= 20 THEN (n*m + 10*g)/(n + 10) ELSE g END, 6) AS brand_te
FROM per LEFT JOIN s USING (brand), g WHERE NOT train""")
def _(t):
    train, test = t.players.where("date_id <= 19971231"), t.players.where("date_id > 19971231")
    enc = N.fit_target_encoding(train, "brand", "actual_points", smoothing=10, min_samples=20)
    return rounded(N.apply_target_encoding(test, enc, "brand", "brand_te"), ["player_id", "contest_id"], ["brand_te"])


@query("C03_frequency_encoding", """
, f AS (SELECT weight_class, count(*)/(SELECT count(weight_class) FROM players) AS fr FROM players GROUP BY 1)
SELECT player_id, contest_id, round(fr, 6) AS weight_class_freq FROM players LEFT JOIN f USING (weight_class)""")
def _(t):
    return rounded(N.frequency_encoding(t.players, "weight_class", "weight_class_freq"), ["player_id", "contest_id"],
                   ["weight_class_freq"])


@query("C04_quantile_bins", """
, q AS (SELECT list_sort(list_distinct(quantile_cont(actual_points, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed FROM players)
SELECT bin, count(*) AS n, round(min(actual_points), 6) AS lo, round(max(actual_points), 6) AS hi FROM (
  SELECT actual_points, greatest(len(list_filter(ed, lambda x: x < actual_points)) - 1, 0)::INT AS bin FROM players, q) GROUP BY 1""")
def _(t):
    d = N.quantile_bins(t.players, "actual_points", 5, "bin")
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.min("actual_points")).alias("lo"),
                                r6(F.max("actual_points")).alias("hi"))


@query("C05_contest_features", """
SELECT contest_id, CASE WHEN multi_entry_max > 1 THEN 'MME' WHEN contest_size <= 20 THEN 'SE' ELSE 'limited' END AS contest_type,
  coalesce(multi_entry_max > 1, false)::INT AS is_mme, coalesce(multi_entry_max = 1, false)::INT AS is_se,
  round(ln(1 + contest_size), 6) AS log_field_size, round(ln(1 + entry_fee), 6) AS log_entry_cost, """
       + case_sql("contest_size", P.CONTEST_SIZE) + """ AS size_bucket FROM contests""")
def _(t):
    c = N.contest_features(t.contests)
    return c.select("contest_id", "contest_type", "is_mme", "is_se", r6("log_field_size").alias("log_field_size"),
                    r6("log_entry_cost").alias("log_entry_cost"), "size_bucket")


# ---- scalar functions ------------------------------------------------------

@query("F01_normalize_name", r"""
, n AS (SELECT doc_id, concat(source, '-', coalesce(text, ''), '.') AS nm FROM documents)
SELECT doc_id, trim(regexp_replace(replace(replace(lower(nm), '-', ' '), '.', ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS norm FROM n""")
def _(t):
    d = t.documents.select("doc_id", F.concat("source", F.lit("-"), F.coalesce("text", F.lit("")), F.lit(".")).alias("nm"))
    return d.select("doc_id", S.normalize_name("nm").alias("norm"))


@query("F02_last_and_reversed_name", """
SELECT p_partkey, split_part(p_name, ' ', 2) AS last_name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS reversed
FROM part""")
def _(t):
    n = S.normalize_name("p_name")
    return t.part.select("p_partkey", S.last_name(n).alias("last_name"), S.reversed_name(n).alias("reversed"))


@query("F04_american_to_probability", """
SELECT quote_id, round(CASE WHEN odds_a > 0 THEN 100/(odds_a+100) WHEN odds_a < 0 THEN -odds_a/(100-odds_a)
       WHEN odds_a = 0 THEN 0.5::DOUBLE END, 6) AS prob_a FROM snapshots""")
def _(t):
    return t.snapshots.select("quote_id", r6(S.american_to_prob("odds_a")).alias("prob_a"))


@query("F05_edge_and_kelly", """
, s AS (SELECT *, CASE WHEN odds_a > 0 THEN 100/(odds_a+100) WHEN odds_a < 0 THEN -odds_a/(100-odds_a) ELSE 0.5::DOUBLE END AS be,
        CASE WHEN odds_a > 0 THEN odds_a/100 WHEN odds_a < 0 THEN 100/(-odds_a) END AS b, (quote_id % 97)/97 AS p FROM snapshots)
SELECT quote_id, round(be, 6) AS break_even, round(p - be, 6) AS edge,
       round(CASE WHEN b IS NULL THEN 0 ELSE greatest(0, (b*p - (1-p))/b)*0.25::DOUBLE END, 6) AS stake FROM s""")
def _(t):
    p = (F.col("quote_id") % 97) / 97
    return t.snapshots.select("quote_id", r6(S.break_even("odds_a")).alias("break_even"),
                              r6(S.edge(p, "odds_a")).alias("edge"), r6(S.kelly(p, "odds_a", 0.25)).alias("stake"))


@query("F06_instants_and_local_dates", """
SELECT contest_id, epoch(strptime(day_id::VARCHAR, '%Y%m%d') + INTERVAL 26 HOUR)::BIGINT AS closing_epoch,
       strftime(contest_date + to_hours((contest_id % 24)::INT) - INTERVAL 6 HOUR, '%Y%m%d')::INT AS local_id FROM contests""")
def _(t):
    iso = F.date_format(F.col("contest_date") + F.make_dt_interval(hours=(F.col("contest_id") % 24).cast("int")),
                        "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.contests.select("contest_id", F.unix_timestamp(S.closing_instant("day_id")).alias("closing_epoch"),
                             S.local_date_id(iso).alias("local_id"))


@query("F07_date_parse", """
SELECT contest_id, strftime(strptime(day_id::VARCHAR, '%Y%m%d'), '%Y-%m-%d') AS event_date FROM contests""")
def _(t):
    return t.contests.select("contest_id", S.date_from_id("day_id").cast("string").alias("event_date"))


@query("F08_calendar_parts", """
SELECT contest_id, (isodow(contest_date)-1)::INT AS dow, month(contest_date)::INT AS month, week(contest_date)::INT AS week,
       (isodow(contest_date) >= 6)::INT AS is_weekend, day(contest_date)::INT AS day, quarter(contest_date)::INT AS quarter FROM contests""")
def _(t):
    return t.contests.select("contest_id", *[c.alias(k) for k, c in S.calendar_parts("contest_date").items()])


@query("F09_cyclic_encoding", """
SELECT contest_id, round(sin(2*pi()*month(contest_date)/12), 6) + 0.0 AS month_sin, round(cos(2*pi()*month(contest_date)/12), 6) + 0.0 AS month_cos
FROM contests""")
def _(t):
    s, c = S.cyclic(F.month("contest_date"), 12)
    return t.contests.select("contest_id", r6(s).alias("month_sin"), r6(c).alias("month_cos"))


@query("F10_log_transforms", """
SELECT contest_id, round(ln(1 + greatest(entry_fee - 5, 0)), 6) AS log_fee, round(ln(1 + contest_size), 6) AS log_size FROM contests""")
def _(t):
    return t.contests.select("contest_id", r6(S.log_shift(F.col("entry_fee") - 5)).alias("log_fee"),
                             r6(S.log_shift(F.col("contest_size").cast("double"))).alias("log_size"))


@query("F11_power_transforms", """
SELECT c_custkey, round(sqrt(greatest(c_acctbal, 0)), 6) AS root, round(c_acctbal*c_acctbal, 4) AS squared,
       round(sign(c_acctbal)*pow(abs(c_acctbal), 1.5), 4) AS signed_pow FROM customer""")
def _(t):
    return t.customer.select("c_custkey", r6(S.signed_power("c_acctbal", 0.5)).alias("root"),
                             r6(S.signed_power("c_acctbal", 2), 4).alias("squared"),
                             r6(S.signed_power("c_acctbal", 1.5), 4).alias("signed_pow"))


@query("F12_ratios_and_interactions", """
SELECT p_partkey, round(p_retailprice/(p_size + 1e-8), 6) AS ratio, round(p_retailprice*p_size, 6) AS product,
       round(p_retailprice + p_size, 6) AS total FROM part""")
def _(t):
    return t.part.select("p_partkey", r6(S.safe_ratio("p_retailprice", "p_size")).alias("ratio"),
                         r6(F.col("p_retailprice") * F.col("p_size")).alias("product"),
                         r6(F.col("p_retailprice") + F.col("p_size")).alias("total"))


@query("F13_clip", """
SELECT contest_id, least(greatest(contest_size, 5000), 40000)::DOUBLE AS clipped,
       CASE WHEN cash_line IS NOT NULL THEN least(greatest(cash_line, 2), 3)::DOUBLE END AS cash_clipped FROM contests""")
def _(t):
    return t.contests.select("contest_id", S.clip("contest_size", 5000, 40000).cast("double").alias("clipped"),
                             S.clip("cash_line", 2, 3).cast("double").alias("cash_clipped"))


@query("F16_parameter_hash", """
SELECT p_partkey, substr(md5('{"brand":"' || p_brand || '","size":' || p_size || '}'), 1, 8) AS h FROM part""")
def _(t):
    return t.part.select("p_partkey", S.params_hash(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
                         .alias("h"))


@query("F17_round_sign_cast", """
SELECT c_custkey, round(c_acctbal, 0) AS rounded, sign(c_acctbal)::INT AS sgn, abs(c_acctbal) AS magnitude,
       coalesce(nullif(c_nationkey, 0), -1)::INT AS nation FROM customer""")
def _(t):
    return t.customer.select("c_custkey", r6("c_acctbal", 0).alias("rounded"), F.signum("c_acctbal").cast("int").alias("sgn"),
                             F.abs("c_acctbal").alias("magnitude"),
                             F.coalesce(F.nullif("c_nationkey", F.lit(0)), F.lit(-1)).cast("int").alias("nation"))


def _z_sql() -> str:
    from statistics import NormalDist
    return "CASE contest_id % 10 " + " ".join(f"WHEN {i} THEN {NormalDist().inv_cdf((i + 0.5) / 10)!r}::DOUBLE" for i in range(10)) + " END"


@query("F18_normal_distribution", f"""
SELECT contest_id, round({_z_sql()}, 6) AS z, round((contest_id % 10 + 0.5::DOUBLE)/10, 6) AS p_back FROM contests""")
def _(t):
    d = t.contests.withColumn("p", (F.col("contest_id") % 10 + 0.5) / 10)
    return d.select("contest_id", r6(S.normal_ppf("p")).alias("z"), r6(S.normal_cdf(S.normal_ppf("p"))).alias("p_back"))


@query("F19_effective_entries", f"""
, f AS (SELECT *, CASE WHEN contest_size > 0 THEN least(coalesce(multi_entry_max, 999), contest_size)/contest_size END AS eff FROM contests)
SELECT contest_id, round(eff, 6) AS eff, {case_sql('eff', P.EFFECTIVE_ENTRIES)} AS eff_band FROM f""")
def _(t):
    c = t.contests.withColumn("e", R.effective_entries())
    return c.select("contest_id", r6("e").alias("eff"), B.apply_band("e", P.EFFECTIVE_ENTRIES).alias("eff_band"))


@query("F20_ownership_gap_band", f"""
, g AS (SELECT *, ownership - 35*close_prob AS gap FROM players)
SELECT player_id, contest_id, round(gap, 6) AS gap, {case_sql('gap', P.OWN_GAP)} AS gap_band FROM g""")
def _(t):
    g = t.players.withColumn("g", F.col("ownership") - 35 * F.col("close_prob"))
    return g.select("player_id", "contest_id", r6("g").alias("gap"), B.apply_band("g", P.OWN_GAP).alias("gap_band"))
