"""Role views: the engine's domain shapes expressed on the given tables.

``contests`` come from orders, ``entries`` (weighted stakes in a contest) and
``players`` (members with price, share and outcome) from line items joined to
their order, ``snapshots`` (quotes over time) from events.  PRELUDE states the
same views for the SQL oracle.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F

from ledgerfold.session import materialize

if TYPE_CHECKING:
    from ledgerfold.plans.registry import Tables

# Contest names and entry caps by order key, so that every
# family pattern and archetype rule is reached.
CONTEST_NAMES = ["mini-MAX night", "The Throwdown", "Arm Bar", "Hook & Jab", "Left Hook", "big HAYMAKER", "Special",
                 "Plain"]
ENTRY_CAPS = [None, 1, 3, 18, 20, 150, 151, 2]


def _pick(key, values):
    chain = None
    for i, v in enumerate(values):
        cond = F.col(key) % len(values) == i
        chain = F.when(cond, F.lit(v)) if chain is None else chain.when(cond, F.lit(v))
    return chain


def contests(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").alias("contest_id"),
        (F.year(d) * 10000 + F.month(d) * 100 + 1).alias("date_id"),
        (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).alias("day_id"),
        d.alias("contest_date"),
        _pick("o_orderkey", CONTEST_NAMES).alias("contest_name"),
        (F.col("o_orderkey") % 26).cast("double").alias("entry_fee"),
        F.floor(F.col("o_totalprice") / 8).cast("int").alias("contest_size"),
        _pick("o_orderkey", ENTRY_CAPS).cast("int").alias("multi_entry_max"),
        (F.lit(9) + F.col("o_custkey") % 7).cast("int").alias("fight_count"),
        F.when(F.col("o_orderkey") % 9 != 0, 1 + F.col("o_orderkey") % 3).cast("int").alias("cash_line"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total_prizes"),
    )


def entries(t: Tables) -> DataFrame:
    """One row per line item: payout, cost and weight with the set's features."""
    x = F.col("l_extendedprice")
    gate = F.col("l_suppkey") % 10 != 0
    li = t.lineitem.select(
        F.col("l_orderkey").alias("contest_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("l_linenumber").alias("line_no"),
        F.when(F.col("l_returnflag") != "R", x * (1 - F.col("l_discount"))).otherwise(F.lit(0.0)).alias("payout"),
        (x * 0.65).alias("cost"),
        F.col("l_quantity").alias("user_count"),
        (F.col("l_tax") * 100).alias("lineup_percentile"),
        (x / 400).alias("total_ownership"),
        (50000 - (F.col("l_partkey") * 50) % 2550).alias("total_salary"),
        F.when(gate, F.col("l_linenumber") - 1).alias("favorite_count"),
        F.when(gate, F.col("l_linenumber") % 4).alias("tossup_count"),
        F.when(gate, F.col("l_discount") * 20 + 2.25).alias("implied_prob_sum"),
        F.when(gate, F.col("l_tax") * 20).alias("own_prob_ratio"),
        (F.col("l_quantity").cast("int") * F.col("l_linenumber")).alias("lineup_count"),
        (F.col("l_discount") * 200).alias("min_ownership"),
        (F.col("l_quantity") * 2).alias("max_ownership"),
        ((F.col("l_partkey") * 100) % 5600).alias("salary_spread"),
        F.round(F.col("l_quantity") * 3 + F.col("l_discount") * 100, 2).alias("points"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("l_extendedprice").alias("price"),
    )
    return li.join(contests(t), "contest_id")


def players(t: Tables) -> DataFrame:
    """Member x contest rows, unique by (player, contest): the dearest line wins."""
    li = t.lineitem.groupBy(F.col("l_partkey").alias("player_id"), F.col("l_orderkey").alias("contest_id")).agg(
        F.max(F.struct("l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_suppkey")).alias("m"))
    s = li.select(
        "player_id", "contest_id",
        (6000 + (F.col("player_id") * 100) % 4700).alias("salary"),
        (F.col("m.l_discount") * 400 + F.col("m.l_tax") * 50).alias("ownership"),
        (F.floor(F.col("m.l_extendedprice") / 10) / 100).alias("actual_points"),
        (F.col("m.l_quantity") / 51).alias("close_prob"),
        F.when(F.col("m.l_suppkey") % 6 != 0, F.col("m.l_quantity") / 51 - (F.col("m.l_tax") - 0.04) * 3)
        .alias("open_prob"),
    )
    s = s.withColumn("line_move", F.col("close_prob") - F.col("open_prob"))
    c = contests(t).select("contest_id", "date_id", "day_id", "contest_date", "contest_size", "entry_fee",
                           "multi_entry_max", "user_id", "status")
    p = t.part.select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("full_name"),
                      F.col("p_type").alias("weight_class"), F.col("p_brand").alias("brand"),
                      F.col("p_size").alias("p_size"))
    return s.join(c, "contest_id").join(p, "player_id")


PART_COLUMNS = {"full_name": "p_name", "weight_class": "p_type", "brand": "p_brand", "p_size": "p_size"}


def players_table(t: Tables, *columns: str) -> DataFrame:
    """Some columns of :func:`players`, written once for a query that reads them several times.

    The lines are dealt out by contest once: they meet their contest's rows, kept in one
    list, and the dearest line of a member is found where they met.  Of the line only what
    the columns, or a choice between lines with another outcome, ask for is shuffled.
    """
    of_contest = [c for c in ("date_id", "day_id", "contest_date", "contest_size", "entry_fee", "multi_entry_max", "user_id", "status") if c in columns]
    of_part = [F.col(v).alias(k) for k, v in PART_COLUMNS.items() if k in columns]
    quoted = bool({"open_prob", "line_move"} & set(columns))  # the supplier comes last in the choice and decides nothing else
    line = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"] + ["l_suppkey"] * quoted
    c = contests(t).where("contest_id IS NOT NULL").groupBy("contest_id").agg(F.collect_list(F.struct(F.lit(1).alias("_one"), *of_contest)).alias("_c"))
    li = t.lineitem.select(F.col("l_partkey").alias("player_id"), F.col("l_orderkey").alias("contest_id"), *line).where("player_id IS NOT NULL")
    s = li.join(c, "contest_id").groupBy("player_id", "contest_id").agg(F.max(F.struct(*line)).alias("m"), F.first("_c").alias("_c"))
    q = F.col("m.l_quantity") / 51
    open_prob = F.when(F.col("m.l_suppkey") % 6 != 0, q - (F.col("m.l_tax") - 0.04) * 3) if quoted else F.lit(None)
    made = {"player_id": F.col("player_id"), "contest_id": F.col("contest_id"), "salary": 6000 + (F.col("player_id") * 100) % 4700,
            "ownership": F.col("m.l_discount") * 400 + F.col("m.l_tax") * 50, "actual_points": F.floor(F.col("m.l_extendedprice") / 10) / 100,
            "close_prob": q, "open_prob": open_prob, "line_move": q - open_prob}
    s = s.select(*[v.alias(k) for k, v in made.items() if k in columns or k == "player_id"], F.explode("_c").alias("_c"))
    s = s.select(*[k for k in s.columns if k != "_c"], *[F.col(f"_c.{k}").alias(k) for k in of_contest])
    p = t.part.select(F.col("p_partkey").alias("player_id"), *of_part)
    return materialize(s.join(p, "player_id").select(*columns), "players")


def snapshots(t: Tables) -> DataFrame:
    """Two-sided American quotes: market = (user, event type, ten days)."""
    return t.events.select(
        F.concat_ws("-", F.date_format("ts", "yyyyMM"), F.expr("(day(ts) - 1) div 10").cast("string"), F.col("user_id"),
                    F.col("event_type")).alias("event_id"),
        (F.date_format("ts", "yyyyMM").cast("int") * 100 + 1 + 10 * F.expr("(day(ts) - 1) div 10").cast("int"))
        .alias("date_id"),
        F.col("ts").alias("snapshot_ts"),
        F.concat(F.lit("book"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")).alias("book"),
        F.concat(F.lit("a"), F.col("user_id")).alias("side_a"),
        F.concat(F.lit("b"), F.col("user_id")).alias("side_b"),
        (F.round(F.col("value") * 20) - 400).alias("odds_a"),
        (380 - F.round(F.col("value") * 20)).alias("odds_b"),
        F.col("event_id").alias("quote_id"),
    )


# The same four views for the oracle.
PRELUDE = """
WITH contests AS (
  SELECT o_orderkey AS contest_id,
         (year(o_orderdate)*10000 + month(o_orderdate)*100 + 1)::INT AS date_id,
         (year(o_orderdate)*10000 + month(o_orderdate)*100 + day(o_orderdate))::INT AS day_id,
         o_orderdate AS contest_date,
         CASE o_orderkey % 8 WHEN 0 THEN 'mini-MAX night' WHEN 1 THEN 'The Throwdown' WHEN 2 THEN 'Arm Bar'
              WHEN 3 THEN 'Hook & Jab' WHEN 4 THEN 'Left Hook' WHEN 5 THEN 'big HAYMAKER' WHEN 6 THEN 'Special'
              ELSE 'Plain' END AS contest_name,
         (o_orderkey % 26)::DOUBLE AS entry_fee,
         floor(o_totalprice/8)::INT AS contest_size,
         CASE o_orderkey % 8 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 18 WHEN 4 THEN 20 WHEN 5 THEN 150
              WHEN 6 THEN 151 WHEN 7 THEN 2 END AS multi_entry_max,
         (9 + o_custkey % 7)::INT AS fight_count,
         CASE WHEN o_orderkey % 9 <> 0 THEN (1 + o_orderkey % 3)::INT END AS cash_line,
         o_custkey AS user_id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total_prizes
  FROM orders),
entries AS (
  SELECT l_orderkey AS contest_id, l_partkey AS part_id, l_suppkey AS supp_id, l_linenumber AS line_no,
         CASE WHEN l_returnflag <> 'R' THEN l_extendedprice*(1-l_discount) ELSE 0.0::DOUBLE END AS payout,
         l_extendedprice*0.65::DOUBLE AS cost, l_quantity AS user_count, l_tax*100 AS lineup_percentile,
         l_extendedprice/400 AS total_ownership, (50000 - (l_partkey*50) % 2550) AS total_salary,
         CASE WHEN l_suppkey % 10 <> 0 THEN l_linenumber-1 END AS favorite_count,
         CASE WHEN l_suppkey % 10 <> 0 THEN l_linenumber%4 END AS tossup_count,
         CASE WHEN l_suppkey % 10 <> 0 THEN l_discount*20 + 2.25::DOUBLE END AS implied_prob_sum,
         CASE WHEN l_suppkey % 10 <> 0 THEN l_tax*20 END AS own_prob_ratio,
         (l_quantity::INT * l_linenumber) AS lineup_count, l_discount*200 AS min_ownership,
         l_quantity*2 AS max_ownership, (l_partkey*100) % 5600 AS salary_spread,
         round(l_quantity*3 + l_discount*100, 2) AS points, l_shipdate AS ship_date, l_extendedprice AS price,
         c.* EXCLUDE (contest_id)
  FROM lineitem JOIN contests c ON l_orderkey = c.contest_id),
players AS (
  SELECT m.player_id, m.contest_id, 6000 + (m.player_id*100) % 4700 AS salary,
         x.d*400 + x.t*50 AS ownership, floor(x.e/10)/100 AS actual_points, x.q/51 AS close_prob,
         CASE WHEN x.s % 6 <> 0 THEN x.q/51 - (x.t - 0.04::DOUBLE)*3 END AS open_prob,
         x.q/51 - CASE WHEN x.s % 6 <> 0 THEN x.q/51 - (x.t - 0.04::DOUBLE)*3 END AS line_move,
         c.date_id, c.day_id, c.contest_date, c.contest_size, c.entry_fee, c.multi_entry_max, c.user_id, c.status,
         p_name AS full_name, p_type AS weight_class, p_brand AS brand, p_size
  FROM (SELECT l_partkey AS player_id, l_orderkey AS contest_id,
               max({'e': l_extendedprice, 'd': l_discount, 't': l_tax, 'q': l_quantity, 's': l_suppkey}) AS x
        FROM lineitem GROUP BY 1, 2) m
  JOIN contests c USING (contest_id) JOIN part ON p_partkey = m.player_id),
snapshots AS (
  SELECT strftime(ts, '%Y%m') || '-' || ((day(ts)-1)//10) || '-' || user_id || '-' || event_type AS event_id,
         (strftime(ts, '%Y%m')::INT*100 + 1 + 10*((day(ts)-1)//10))::INT AS date_id, ts AS snapshot_ts,
         'book' || ((props->>'$.k')::INT % 5) AS book, 'a' || user_id AS side_a, 'b' || user_id AS side_b,
         round(value*20) - 400 AS odds_a, 380 - round(value*20) AS odds_b, event_id AS quote_id
  FROM events)
"""
