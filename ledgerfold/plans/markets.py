"""Market quotes on the events table (S05, A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import scalars as S
from ledgerfold.operators import prices as M
from ledgerfold.plans.registry import query, r6

PROB = "CASE WHEN {0} > 0 THEN 100/({0}+100) WHEN {0} < 0 THEN -{0}/(100-{0}) WHEN {0} = 0 THEN 0.5::DOUBLE END"
QUOTES = f"""
, raw AS (SELECT *, {PROB.format('odds_a')} AS prob_a, {PROB.format('odds_b')} AS prob_b FROM snapshots),
oc AS (
  SELECT event_id, date_id, book, side_a, side_b, 'opening' AS line_type, arg_min({{'t': snapshot_ts, 'a': prob_a, 'b': prob_b}}, {{'t': snapshot_ts, 'q': quote_id}}) AS x
  FROM raw GROUP BY 1,2,3,4,5
  UNION ALL
  SELECT event_id, date_id, book, side_a, side_b, 'closing', arg_max({{'t': snapshot_ts, 'a': prob_a, 'b': prob_b}}, {{'t': snapshot_ts, 'q': quote_id}})
  FROM raw GROUP BY 1,2,3,4,5),
cons AS (SELECT event_id, date_id, side_a, side_b, line_type, avg(x.a) AS pa, avg(x.b) AS pb, count(DISTINCT book) AS n_books,
         min(x.t) AS ts FROM oc GROUP BY 1,2,3,4,5),
fair AS (SELECT *, pa/(pa+pb) AS fa, pb/(pa+pb) AS fb FROM cons),
pan AS (SELECT event_id, date_id, side_a, side_b, max(fa) FILTER (line_type='opening') AS open_a, max(fa) FILTER (line_type='closing') AS close_a,
        max(fb) FILTER (line_type='opening') AS open_b, max(fb) FILTER (line_type='closing') AS close_b,
        max(n_books) FILTER (line_type='opening') AS open_n_books, max(n_books) FILTER (line_type='closing') AS close_n_books
        FROM fair GROUP BY 1,2,3,4),
sides AS (SELECT event_id, date_id, 'a' AS side, side_a AS name, open_a AS open_prob, close_a AS close_prob, side_b AS opponent, close_b AS opponent_close FROM pan
          UNION ALL SELECT event_id, date_id, 'b', side_b, open_b, close_b, side_a, close_a FROM pan)
"""
KEY = ["event_id", "date_id", "side_a", "side_b"]


def raw(t):
    return t.snapshots.withColumn("prob_a", S.american_to_prob("odds_a")).withColumn("prob_b", S.american_to_prob("odds_b"))


def lines(t):
    return M.open_close(raw(t), [*KEY, "book"], "snapshot_ts", "quote_id", ["prob_a", "prob_b"])


def fair(t):
    return M.devig(M.consensus(lines(t), [*KEY, "line_type"]))


def sides(t):
    return M.side_explode(M.price_panel(fair(t), KEY), ["event_id", "date_id"])


def nested(t):
    """Quotes as nested JSON text, one document per quote."""
    outcome = lambda n, p: F.struct(F.col(n).alias("name"), F.col(p).cast("double").alias("price"))
    h2h = F.struct(F.lit("h2h").alias("key"), F.array(outcome("side_a", "odds_a"), outcome("side_b", "odds_b")).alias("outcomes"))
    totals = F.struct(F.lit("totals").alias("key"), F.array(outcome("side_a", "odds_a")).alias("outcomes"))
    doc = F.struct(F.col("event_id").alias("id"), F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"),
                   F.array(F.struct(F.col("book").alias("key"), F.upper("book").alias("title"),
                                    F.array(h2h, totals).alias("markets"))).alias("bookmakers"))
    return t.snapshots.select("quote_id", F.to_json(doc).alias("doc"))


@query("S05_nested_quotes", f"""
SELECT quote_id, event_id, book, side_a, side_b, odds_a, odds_b, round({PROB.format('odds_a')}, 6) AS prob_a,
       round({PROB.format('odds_b')}, 6) AS prob_b, strftime(snapshot_ts - INTERVAL 6 HOUR, '%Y%m%d')::INT AS local_id FROM snapshots""")
def _(t):
    p = M.parse_events(nested(t), "doc", ["quote_id"])
    return p.select("quote_id", "event_id", "book", "side_a", "side_b", "odds_a", "odds_b", r6("prob_a").alias("prob_a"),
                    r6("prob_b").alias("prob_b"), S.local_date_id("commence_time").alias("local_id"))


@query("F15_nested_navigation", f"""
SELECT quote_id, round({PROB.format('odds_a')}, 6) AS mean_prob FROM snapshots""")
def _(t):
    d = nested(t).withColumn("doc", F.from_json("doc", M.EVENT))
    return d.select("quote_id", r6(M.mean_first_side("doc")).alias("mean_prob"))


@query("A01_open_close", QUOTES + """
SELECT event_id, book, line_type, floor(epoch(x.t))::BIGINT AS at, round(x.a, 6) AS prob_a FROM oc""")
def _(t):
    return lines(t).select("event_id", "book", "line_type", F.unix_timestamp("snapshot_ts").alias("at"), r6("prob_a").alias("prob_a"))


@query("A02_consensus", QUOTES + """
SELECT event_id, line_type, round(pa, 6) AS prob_a, round(pb, 6) AS prob_b, n_books FROM cons""")
def _(t):
    return M.consensus(lines(t), [*KEY, "line_type"]).select("event_id", "line_type", r6("prob_a").alias("prob_a"),
                                                             r6("prob_b").alias("prob_b"), "n_books")


@query("A03_devig", QUOTES + "SELECT event_id, line_type, round(fa, 6) AS fair_a, round(fb, 6) AS fair_b FROM fair")
def _(t):
    return fair(t).select("event_id", "line_type", r6("fair_a").alias("fair_a"), r6("fair_b").alias("fair_b"))


@query("A04_line_movement", QUOTES + """
SELECT event_id, line_type, round(fa, 6) AS fair_a, round(close_a - open_a, 6) + 0.0::DOUBLE AS move_a
FROM fair JOIN pan USING (event_id)""")
def _(t):
    return M.line_movement(fair(t), KEY).select("event_id", "line_type", r6("fair_a").alias("fair_a"), r6("move_a").alias("move_a"))


@query("A05_price_panel", QUOTES + """
SELECT event_id, date_id, round(open_a, 6) AS open_a, round(close_a, 6) AS close_a, round(open_b, 6) AS open_b,
       round(close_b, 6) AS close_b, open_n_books, close_n_books FROM pan""")
def _(t):
    return M.price_panel(fair(t), KEY).select("event_id", "date_id", *[r6(c).alias(c) for c in ("open_a", "close_a", "open_b", "close_b")],
                                              "open_n_books", "close_n_books")


ALIAS_SQL = """
, alias AS (SELECT 'a' || c_custkey AS name, c_custkey AS entity_id, c_name FROM customer
            UNION ALL SELECT 'b' || c_custkey, c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0)
"""


@query("A06_side_explode", QUOTES + ALIAS_SQL + """
SELECT event_id, side, name, entity_id, round(open_prob, 6) AS open_prob, round(close_prob, 6) AS close_prob,
       (close_prob > 0.5)::INT AS is_favorite, opponent, round(opponent_close, 6) AS opponent_close
FROM sides JOIN alias USING (name)""")
def _(t):
    c = t.customer
    alias = c.select(F.concat(F.lit("a"), "c_custkey").alias("name"), F.col("c_custkey").alias("entity_id")).unionByName(
        c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("b"), "c_custkey").alias("name"), F.col("c_custkey").alias("entity_id")))
    return sides(t).join(alias, "name").select(
        "event_id", "side", "name", "entity_id", r6("open_prob").alias("open_prob"), r6("close_prob").alias("close_prob"),
        "is_favorite", "opponent", r6("opponent_close").alias("opponent_close"))


@query("A07_price_coverage", QUOTES + """
SELECT count(DISTINCT date_id) AS n_dates, count(DISTINCT name) AS n_entities, count(*) AS n_rows,
       round(avg((open_prob IS NOT NULL)::INT), 6) AS open_share, round(avg(((close_prob - open_prob) IS NOT NULL)::INT), 6) AS move_share,
       round(avg((close_prob > 0.5)::INT), 6) AS favorite_share, round(avg(close_prob), 6) AS mean_close FROM sides""")
def _(t):
    c = M.coverage(sides(t))
    return c.select("n_dates", "n_entities", "n_rows", *[r6(x).alias(x) for x in
                                                        ("open_share", "move_share", "favorite_share", "mean_close")])


@query("A08_price_quality", """
, one AS (SELECT date_id, player_id, max(close_prob) AS prob, max(open_prob) AS prop FROM players GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN prob IS NULL THEN 'none' WHEN prop IS NOT NULL THEN 'high' ELSE 'medium' END AS tier FROM one)
SELECT date_id, tier, count(*) AS n FROM q GROUP BY 1, 2""")
def _(t):
    one = t.players.groupBy("date_id", "player_id").agg(F.max("close_prob").alias("prob"), F.max("open_prob").alias("prop"))
    return one.withColumn("tier", M.quality_tier()).groupBy("date_id", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("P14_move_direction", QUOTES + """
, m AS (SELECT *, close_prob - open_prob AS mv FROM sides)
SELECT CASE WHEN mv IS NULL THEN 'unknown' WHEN mv > 0.02::DOUBLE THEN 'steamed' WHEN mv < -0.02::DOUBLE THEN 'drifted' ELSE 'stable' END AS direction,
       CASE WHEN abs(mv) < 0.02::DOUBLE THEN NULL WHEN abs(mv) < 0.05::DOUBLE THEN '2-5pp' WHEN abs(mv) < 0.1::DOUBLE THEN '5-10pp'
            WHEN abs(mv) < 0.2::DOUBLE THEN '10-20pp' WHEN abs(mv) >= 0.2::DOUBLE THEN '20pp+' END AS steam, count(*) AS n FROM m GROUP BY 1, 2""")
def _(t):
    from ledgerfold import presets as P
    from ledgerfold.functions.bands import apply_band
    return sides(t).groupBy(M.move_direction().alias("direction"),
                            apply_band(F.abs("line_move"), P.STEAM_SIZE).alias("steam")).agg(F.count(F.lit(1)).alias("n"))
