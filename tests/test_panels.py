"""Analysis panels on hand-made rows."""

from ledgerfold.operators import panels as N

SCHEMA = ("date_id int, player_id long, contest_id long, contest_size int, full_name string, weight_class string, multi_entry_max int, salary int, "
          "ownership double, actual_points double, open_prob double, close_prob double, line_move double")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(player, *, date=1, contest=1, size=10, name="n", cls="Lightweight", cap=1, salary=8000, own=10.0, points=64.0, opened=0.5, closed=0.6, move=0.1):
    return (date, player, contest, size, name, cls, cap, salary, own, points, opened, closed, move)


def test_one_row_per_event_is_that_of_the_largest_contest(spark):
    df = frame(spark, [row(1, contest=5, size=9), row(1, contest=4, size=9), row(1, contest=3, size=8), row(2, contest=9), row(1, date=2, contest=7, size=1)])
    got = {(r.date_id, r.player_id, r.contest_id) for r in N.one_per_event(df, ["date_id", "player_id"]).collect()}
    assert got == {(1, 1, 4), (1, 2, 9), (2, 1, 7)}
    assert {(r.full_name, r.contest_id, r.player_id) for r in N.archetype_members(df.where("date_id = 1")).collect()} == {("n", 9, 2)}


def test_detailed_panel(spark):
    df = frame(spark, [row(1), row(2, cls="Women's Flyweight", points=80.0, closed=0.3, move=-0.1), row(3, cls="Catch Weight", points=9.0, move=None),
                       row(4, cls=None, salary=0), row(5, closed=None), row(6, points=None), row(7, cls="W-Strawweight", points=0.0, move=0.02)])
    got = {r.player_id: r for r in N.detailed(df).collect()}
    assert set(got) == {1, 2, 3, 4, 7}
    assert [(got[k].gender, got[k].weight_group) for k in (1, 2, 3, 4, 7)] == [
        ("Men's", "Lightweight"), ("Women's", "W-Flyweight"), ("Unknown", "Other"), ("Unknown", None), ("Women's", "W-Strawweight")]
    assert [(got[k].is_ceiling, got[k].is_smash, got[k].is_dud) for k in (1, 2, 3, 4, 7)] == [
        (True, False, False), (True, True, False), (False, False, True), (None, None, False), (False, False, True)]
    assert [got[k].line_move_dir for k in (1, 2, 3, 7)] == ["steamed", "drifted", "no_data", "stable"]
    assert got[2].fav_dog == "Underdog" and got[1].ownership_band == "5-10%" and got[4].salary_tier is None


def test_composition_panel_measures_duds_by_the_event(spark):
    points = [0.0, 2.0, 3.0, 10.0, 20.0, 30.0, None]
    df = frame(spark, [row(k, points=p, opened=o, closed=0.6, move=None if o is None else 0.6 - o)
                       for k, (p, o) in enumerate(zip(points, [0.59, 0.575, 0.54, 0.45, 0.1, 0.7, None]))])
    got = {r.player_id: r for r in N.composition_members(df).collect()}
    assert {r.event_median for r in got.values()} == {6.5}
    assert [got[k].is_dud for k in range(7)] == [True, False, False, False, False, False, False]
    assert [got[k].steam_magnitude for k in range(7)] == [None, "steamed_small (2-5pp)", "steamed_medium (5-10pp)", "steamed_large (10-20pp)",
                                                          "steamed_huge (20pp+)", None, None]
    assert got[6].line_move_dir == "unknown" and got[6].ceiling_hit is False


def test_panels_of_no_rows(spark):
    df = frame(spark, [])
    for panel in (N.construction, N.detailed, N.archetype_members, N.archetype_prices, N.composition_members):
        assert panel(df).count() == 0


def test_carded_events_number_the_rows_themselves(spark):
    """One join (the carry of the numbering), and only the columns a panel uses; earlier the members were computed twice and joined."""
    from types import SimpleNamespace
    from ledgerfold.plans import panels as L
    cols = "player_id long, contest_id long, salary long, ownership double, actual_points double, close_prob double, open_prob double, line_move double, " \
           "date_id int, contest_size int, full_name string, weight_class string, brand string"
    row = lambda p, c, sal, date, size, name="n", cls="LARGE": (p, c, sal, 1.0, 2.0, 0.5, 0.4, 0.1, date, size, name, cls, "b")
    rows = [row(1, 10, 6000, 1, 5), row(1, 11, 6000, 1, 9), row(2, 10, 9000, 1, 5), row(3, 10, 6000, 1, 5, "b", "A"), row(3, 10, 6000, 1, 5, "a", "Z"),
            row(4, 12, 7000, None, 5), row(5, 13, 7000, 2, None)]
    t = SimpleNamespace(players=spark.createDataFrame(rows, cols))
    out = L.carded_events(t)
    got = sorted((r["date_id"], r["player_id"], r["contest_id"], r["card_section"], r["weight_class"]) for r in out.collect())
    assert got == [(1, 1, 11, "co_main", "LARGE"), (1, 2, 10, "main_event", "LARGE"), (1, 3, 10, "main_card", "Z"), (2, 5, 13, "main_event", "LARGE")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert "brand" not in out.columns and "full_name" not in L.carded_events(t, L.MEMBER).columns
