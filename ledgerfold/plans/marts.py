"""Marts, sinks and the incremental quote flow (R*, S06-S09, S14, S15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerfold import presets as P
from ledgerfold.operators import marts as R, windows as W
from ledgerfold.plans.features import rounded
from ledgerfold.plans.markets import QUOTES, raw
from ledgerfold.plans.people import EXPO, signals
from ledgerfold.plans.registry import query, r6
from ledgerfold.plans.roles import players_table
from ledgerfold.session import materialize, scratch_dir
from ledgerfold.sources import tables as T
from ledgerfold.streaming import quotes as Q

EVENTS_SQL = """
, evd AS (SELECT date_id, strftime(strptime(date_id::VARCHAR, '%Y%m%d'), '%Y-%m-%d') AS event_date, count(DISTINCT contest_id) AS n_contests,
  (SELECT count(DISTINCT player_id) FROM players p WHERE p.date_id = c.date_id) AS n_members FROM contests c GROUP BY 1)
"""


def event_dim(t, members=None):
    return R.event_dim(t.contests, t.players if members is None else members)


@query("R01_event_dimension", EVENTS_SQL + "SELECT date_id, event_date, n_contests, n_members FROM evd")
def _(t):
    return event_dim(t).select("date_id", F.col("event_date").cast("string").alias("event_date"), "n_contests", "n_members")


@query("R01_contest_dimension", """
SELECT contest_id, date_id, entry_fee, contest_size, CASE multi_entry_max WHEN 1 THEN 'Single Entry' WHEN 3 THEN '3-Max' WHEN 20 THEN '20-Max' WHEN 150 THEN '150-Max'
 WHEN 2 THEN 'Limited' WHEN 18 THEN 'Limited' ELSE 'MME' END AS contest_type, cash_line FROM contests WHERE contest_id <> 142690805""")
def _(t):
    return R.contest_dim(t.contests).select("contest_id", "date_id", "entry_fee", "contest_size", "contest_type", "cash_line")


@query("R01_entity_dimension", "SELECT player_id AS canonical_id, min(full_name) AS canonical_name FROM players GROUP BY 1")
def _(t):
    return R.entity_dim(None, t.players).drop("weight_class")


SNAP = """
, one AS (SELECT * FROM players QUALIFY row_number() OVER (PARTITION BY date_id, player_id ORDER BY contest_size DESC, contest_id) = 1),
cp AS (SELECT date_id, player_id, row_number() OVER (PARTITION BY date_id ORDER BY salary DESC, player_id) AS pos FROM (SELECT date_id, player_id, max(salary) AS salary FROM players GROUP BY 1, 2)),
cn AS (SELECT p_name AS canonical_name, min(p_partkey) AS canonical_id FROM part GROUP BY 1),
snap AS (SELECT one.*, cn.canonical_id, CASE WHEN pos = 1 THEN 'main_event' WHEN pos = 2 THEN 'co_main' WHEN pos <= 5 THEN 'main_card' ELSE 'prelim' END AS card_section,
  CASE WHEN salary >= 10000 THEN '$10K+' WHEN salary >= 9000 THEN '$9K-$10K' WHEN salary >= 8000 THEN '$8K-$9K' WHEN salary >= 7000 THEN '$7K-$8K' WHEN salary >= 6000 THEN '$6K-$7K' ELSE 'Under $6K' END AS salary_tier
  FROM one LEFT JOIN cn ON canonical_name = full_name LEFT JOIN cp USING (date_id, player_id))
"""


def snapshot(t, members=None, **kw):
    members = t.players if members is None else members
    best = members.groupBy("date_id", "player_id").agg(F.max("salary").alias("s"))
    sections = W.position_in_group(best, ["date_id"], ["-s", "player_id"], name="pos", labels=P.CARD_SECTIONS, default=P.CARD_DEFAULT,
                                   label_name="card_section").select("date_id", "player_id", "card_section")
    canon = t.part.select(F.col("p_partkey").alias("canonical_id"), F.col("p_name").alias("canonical_name"))
    return R.snapshot_fact(members, sections, canon, **kw)


@query("R02_snapshot_fact", SNAP + """
SELECT date_id, player_id, canonical_id, salary, round(ownership, 6) AS ownership, actual_points, card_section, salary_tier FROM snap""")
def _(t):
    return snapshot(t).select("date_id", "player_id", "canonical_id", "salary", r6("ownership").alias("ownership"), "actual_points", "card_section", "salary_tier")


@query("R03_signal_fact", EXPO + """
, cn AS (SELECT p_brand AS brand, min(p_partkey) AS canonical_id FROM part GROUP BY 1)
SELECT date_id, brand, canonical_id, round(sp - fp, 6) + 0.0::DOUBLE AS delta FROM sig LEFT JOIN cn USING (brand)""")
def _(t):
    canon = t.part.select(F.col("p_partkey").alias("canonical_id"), F.col("p_brand").alias("canonical_name"))
    return R.with_canonical(signals(t), canon, "brand").select("date_id", "brand", "canonical_id", r6("delta").alias("delta"))


def predictions(t, members=None):
    """Share predicted from price for every (date, entity)."""
    return (t.players if members is None else members).groupBy("date_id", "player_id").agg((F.avg("close_prob") * 35).alias("predicted"))


@query("R04_performance_view", EXPO + SNAP + EVENTS_SQL + """
, prd AS (SELECT date_id, player_id, avg(close_prob)*35 AS predicted FROM players GROUP BY 1, 2)
SELECT player_id, event_date, s.salary, card_section, round(predicted, 6) AS predicted, round(sp - fp, 6) + 0.0::DOUBLE AS delta
FROM snap s JOIN evd USING (date_id) LEFT JOIN prd USING (date_id, player_id) LEFT JOIN sig USING (date_id, brand)""")
def _(t):
    # members, signals and snapshot are written once each; what was shuffled for them is gone before the next step
    members = players_table(t, "date_id", "player_id", "contest_id", "user_id", "full_name", "brand", "salary", "contest_size", "close_prob")
    seen = materialize(signals(t, members), "signals")
    snap = materialize(snapshot(t, members, last="salary"), "snapshot")
    snap = snap.join(t.part.select(F.col("p_partkey").alias("player_id"), F.col("p_brand").alias("brand")), "player_id")
    v = R.performance_view(snap, event_dim(t, members), predictions(t, members), seen)
    return v.select("player_id", F.col("event_date").cast("string").alias("event_date"), "salary", "card_section", r6("predicted").alias("predicted"), r6("delta").alias("delta"))


@query("R04_expert_summary_view", EXPO + """
SELECT date_id, count(*) AS n_entities, round(avg(sp - fp), 6) + 0.0::DOUBLE AS avg_delta, round(max(sp - fp), 6) + 0.0::DOUBLE AS max_delta, round(min(sp - fp), 6) + 0.0::DOUBLE AS min_delta,
       round(avg(least(n_experts/5, 1)), 6) AS avg_confidence FROM sig GROUP BY 1""")
def _(t):
    v = R.expert_summary_view(signals(t), event_dim(t))
    return rounded(v, ["date_id", "n_entities"], ["avg_delta", "max_delta", "min_delta", "avg_confidence"])


@query("R04_accuracy_view", SNAP + """
, prd AS (SELECT date_id, player_id, avg(close_prob)*35 AS predicted FROM players GROUP BY 1, 2)
SELECT date_id, player_id, round(abs(ownership - predicted), 6) AS absolute_error FROM snap JOIN prd USING (date_id, player_id)""")
def _(t):
    return rounded(R.accuracy_view(snapshot(t), predictions(t)), ["date_id", "player_id"], ["absolute_error"])


# ---- sinks -------------------------------------------------------------------

def scratch(t, name):
    return f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("S06_overwrite_partitioned", "SELECT date_id, count(*) AS n, round(sum(total_prizes), 2) AS total FROM contests GROUP BY 1")
def _(t):
    path = scratch(t, "overwrite")
    T.overwrite(t.contests.select("date_id", "contest_id", "total_prizes").hint("rebalance", "date_id"), path, ["date_id"])
    return t.spark.read.parquet(path).groupBy("date_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("total_prizes"), 2).alias("total"))


@query("S07_upsert_by_key", """
SELECT date_id, contest_id, CASE WHEN status = 'F' THEN total_prizes*2 ELSE total_prizes END AS total_prizes FROM contests""")
def _(t):
    path = scratch(t, "upsert")
    c = t.contests.select("contest_id", "total_prizes", "date_id", "status")
    T.overwrite(c.drop("status").hint("rebalance", "date_id"), path, ["date_id"])
    new = c.where("status = 'F'").withColumn("total_prizes", F.col("total_prizes") * 2).drop("status")
    T.upsert(t.spark, path, new, ["contest_id", "date_id"], "date_id")
    return t.spark.read.parquet(path).select("date_id", "contest_id", "total_prizes")


@query("S08_json_results", "SELECT priority, count(*) AS n, round(avg(total_prizes), 6) AS mean FROM contests GROUP BY 1")
def _(t):
    path = scratch(t, "json")
    T.write_json(t.contests.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("total_prizes")).alias("mean")), path)
    return t.spark.read.schema("priority string, n bigint, mean double").json(path)


@query("S09_csv_report", "SELECT fight_count, count(*) AS n FROM contests GROUP BY 1")
def _(t):
    path = scratch(t, "csv")
    T.write_csv(t.contests.groupBy("fight_count").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.schema("fight_count int, n bigint").option("header", True).csv(path)


@query("S14_evaluation_results", """
SELECT 'run1' AS run_id, 'price' AS model, '{"alpha": 1.0}' AS config, count(*) AS n FROM players""")
def _(t):
    path = scratch(t, "results")
    m = t.players.agg(F.count(F.lit(1)).alias("n"), F.avg("ownership").alias("mean"))
    T.append_results(T.result_row(t.spark, "run1", "price", m, {"alpha": 1.0}), path)
    return t.spark.read.parquet(path).select("run_id", "model", "config", F.get_json_object("metrics", "$.n").cast("bigint").alias("n"))


@query("S15_seed_dimension", """
, s AS (SELECT * FROM (VALUES (1, 'web'), (2, 'news'), (3, 'forum'), (4, 'book'), (5, 'code')) v(source_id, source_name))
SELECT source_id, source_name, (SELECT count(*) FROM documents WHERE source = source_name) AS n_docs FROM s""")
def _(t):
    dim = T.seed_dimension(t.spark, ["web", "news", "forum", "web", "book", "code"])
    n = t.documents.groupBy(F.col("source").alias("source_name")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "source_name", "left").select("source_id", "source_name", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query("ST01_streaming_open_close", QUOTES + """
, s AS (SELECT event_id, min_by({'t': snapshot_ts, 'a': prob_a}, {'t': snapshot_ts, 'q': quote_id}) AS o, max_by({'t': snapshot_ts, 'a': prob_a}, {'t': snapshot_ts, 'q': quote_id}) AS c FROM raw GROUP BY 1)
SELECT event_id, round(o.a, 6) AS open_prob, round(c.a, 6) AS close_prob, floor(epoch(c.t))::BIGINT AS closed_at FROM s""")
def _(t):
    """Quotes arrive as files; open and close are kept up to date by key."""
    landing, target, progress = scratch(t, "landing"), scratch(t, "lines"), scratch(t, "progress")
    raw(t).select("event_id", "snapshot_ts", "quote_id", "prob_a").repartition(3, "quote_id").write.parquet(landing)
    Q.run_available(t.spark, landing, target, progress)
    d = Q.read_lines(t.spark, target)
    return d.select("event_id", r6("open_prob").alias("open_prob"), r6("close_prob").alias("close_prob"), F.unix_timestamp("close_ts").alias("closed_at"))
