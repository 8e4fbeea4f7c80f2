"""Queries whose steps are written one by one: the same rows, read from the lines once."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerfold.operators import marts as R, skill as K
from ledgerfold.plans.registry import Tables
from ledgerfold.plans.roles import players_table

DAY = [datetime.datetime(2001, m, 3) for m in range(1, 7)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders, lines and parts with repeated and missing keys and values."""
    out = str(tmp_path_factory.mktemp("tables"))
    orders = [(k, 1 + k % 3, "F" if k % 2 else "O", 100.0 * k, DAY[k % 6]) for k in range(1, 40)]
    orders += [(7, 2, "F", 5.0, DAY[1]), (7, 2, "F", 5.0, DAY[1]), (None, 1, "F", 1.0, DAY[0]), (50, None, None, None, None)]
    lines = [(1 + i % 42, i % 11 or None, 1 + i % 9, float(100 * (i % 17)), (i % 5) / 100, (i % 4) / 100, float(i % 50)) for i in range(400)]
    lines += lines[:60] + [(None, 3, 1, 1.0, 0.1, 0.1, 1.0), (50, 3, 2, None, 0.1, 0.1, 5.0), (3, 3, 6, 900.0, None, 0.0, 5.0), (3, 3, 7, 900.0, None, 0.0, 5.0)]
    parts = [(k, f"name {k % 4}" if k != 5 else None, "t", f"b{k % 3}", k) for k in range(1, 10)] + [(4, "other", "t", "b9", 4), (None, "x", "t", "b1", 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").withColumn(
        "o_orderpriority", F.lit("5-LOW")).write.parquet(f"{out}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_quantity double").withColumn(
        "l_linenumber", F.lit(1)).write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size long").write.parquet(f"{out}/part.parquet")
    return out


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_written_players_are_the_players(spark, folder):
    t = Tables(spark, folder)
    every = t.players.columns
    assert rows(players_table(t, *every), *every) == rows(t.players, *every) and t.players.count() > 100
    some = ("date_id", "user_id", "brand", "contest_id", "close_prob", "ownership")  # without the supplier
    assert rows(players_table(t, *some), *some) == rows(t.players, *some)


@pytest.mark.parametrize("name", ["K04_exposure_interaction", "R04_performance_view"])
def test_lines_are_read_once(spark, folder, name):
    made = __spark_entry__.queries()[name](spark, folder)
    assert "l_extendedprice" not in made._jdf.queryExecution().analyzed().toString()
    made.collect()


def test_interaction_sums_rows_before_they_meet_the_signals(spark):
    perf = spark.createDataFrame([(1, "a", 1, 4.0, 1.0), (1, "a", 1, None, 3.0), (1, "a", 0, 8.0, None), (2, "a", 1, 6.0, 5.0), (1, "c", 1, 1.0, 1.0), (2, None, 1, 1.0, 1.0)],
                                 "d int, e string, is_favorite int, actual_points double, ownership double")
    signals = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.2), (2, "a", 0.3), (2, None, 1.0)], "d int, e string, delta double")
    got = K.exposure_interaction(signals, perf, keys=("d", "e"))
    assert sorted(tuple(r) for r in got.collect()) == [("experts_over", 0, 1, 8.0, None), ("experts_over", 1, 4, 16 / 3, 3.5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join"):]


def test_a_leading_part_of_the_snapshot_is_the_same(spark):
    members = spark.createDataFrame([(1, 1, "n", 5, 1.0, 1.0, 9, 3, 0.1), (1, 1, "m", 6, 1.0, 1.0, 9, 3, 0.2), (1, 1, None, 7, 1.0, 1.0, 8, 2, 0.2), (1, 2, None, 7, 0.0, 0.0, None, 2, 0.0),
                                     (1, 2, "n", 8, 0.0, 0.0, 1, 2, 0.0)], "date_id int, player_id int, full_name string, salary int, ownership double, actual_points double, contest_size int, contest_id int, close_prob double")
    sections = spark.createDataFrame([(1, 1, "main_event")], "date_id int, player_id int, card_section string")
    canonical = spark.createDataFrame([("n", 4), ("n", 3), ("m", 5)], "canonical_name string, canonical_id int")
    whole, part = (R.snapshot_fact(members, sections, canonical, **kw) for kw in ({}, {"last": "salary"}))
    columns = ("date_id", "player_id", "full_name", "salary", "canonical_id", "card_section", "salary_tier")
    assert rows(whole, *columns) == rows(part, *columns) and "ownership" not in part.columns
    assert [r["full_name"] for r in whole.orderBy("player_id").collect()] == ["m", None]


def test_ownership_features_leave_the_players(spark, folder):
    """The result reads its own steps only, and equals windows over the small tables."""
    made = __spark_entry__.queries()["C01_ownership_features"](spark, folder)
    assert "l_extendedprice" not in made._jdf.queryExecution().analyzed().toString()
    got = made.toPandas()
    p = Tables(spark, folder).players.toPandas()
    p = p[p["contest_id"].isin(got["contest_id"]) & p["date_id"].notna()]
    assert len(got) == len(p)
    size, rank = p.groupby("contest_id").size(), p.groupby("contest_id")["salary"].rank(method="min", ascending=False)
    want = sorted(zip(p["player_id"], p["contest_id"], p["date_id"], rank.astype(int), p["contest_id"].map(size)))
    assert sorted(zip(got["player_id"], got["contest_id"], got["date_id"], got["salary_rank_overall"], got["num_on_slate"])) == want
    panel = p.groupby(["date_id", "player_id"])["salary"].max().reset_index().sort_values(["date_id", "salary", "player_id"], ascending=[True, False, True])
    panel["position"] = panel.groupby("date_id").cumcount() + 1
    place = panel.set_index(["date_id", "player_id"])["position"]
    assert all(place[(d, m)] == k for d, m, k in zip(got["date_id"], got["player_id"], got["card_position"]))
