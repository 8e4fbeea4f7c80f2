"""Names, fuzzy blocking, set repair, quotes, upsert, stream."""

import random
import string
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import identity as D, prices as M, repair as X
from ledgerfold.sources import tables as T
from ledgerfold.streaming import quotes as Q


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_all_six_outcomes(spark):
    cands = frame(spark, [("jon jones", 1), ("ana silva", 2), ("bob silva", 3), ("lee kim", 4), ("maria de souza", 5)], "norm string, id long")
    aliases = frame(spark, [("bones", 1)], "alias string, id long")
    q = frame(spark, [("jon jones",), ("bones",), ("jonny jones",), ("kim lee",), ("maria d souzza",), ("zzz qqq",), ("x silva",)], "norm string")
    got = {r["norm"]: (r["id"], r["method"]) for r in D.match_names(q, cands, aliases).collect()}
    assert got == {"jon jones": (1, "exact"), "bones": (1, "alias"), "jonny jones": (1, "last_name"), "kim lee": (4, "reversed"),
                   "maria d souzza": (5, "fuzzy"), "zzz qqq": (None, "unmatched"), "x silva": (None, "unmatched")}


def test_last_name_counts_ids_not_spellings(spark):
    cands = frame(spark, [("jon jones", 1), ("jonathan jones", 1)], "norm string, id long")
    got = D.match_exact_tiers(frame(spark, [("j jones",)], "norm string"), cands, frame(spark, [], "alias string, id long")).first()
    assert got["id"] == 1 and got["method"] == "last_name"


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_fuzzy_equals_brute_force(spark, threshold):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(60)]

    def noise(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(s))
            if s and rng.random() < 0.5:
                s.pop(min(k, len(s) - 1))
            else:
                s.insert(k, rng.choice(string.ascii_lowercase[:8]))
        return "".join(s) or "z"

    cands = [(c, i) for i, c in enumerate(sorted(set(base)))]
    qs = sorted({noise(c) for c in base for _ in range(2)})
    got = {r["norm"]: (r["id"], r["ratio"]) for r in D.fuzzy_tier(
        frame(spark, [(q,) for q in qs], "norm string"), frame(spark, cands, "norm string, id long"), threshold).collect()}
    want = {}
    for q in qs:
        scored = [(SequenceMatcher(None, q, c).ratio(), -i) for c, i in cands]
        best = max(s for s in scored)
        if best[0] > threshold:
            want[q] = (-best[1], best[0])
    assert got == want


def test_numbered_names_meet_only_their_like(spark):
    # digits in another order are the same letters, but no long enough common subsequence
    cands = frame(spark, [(f"supplier#{k:09d}", k) for k in range(130)], "norm string, id long")
    got = D.blocked_pairs(frame(spark, [(f"aka supplier#{k:09d}",) for k in range(100, 130)], "norm string"), cands, 0.85)
    assert sorted(map(tuple, got.collect())) == [(f"aka supplier#{k:09d}", f"supplier#{k:09d}") for k in range(100, 130)]


def test_long_names_and_letters_outside_the_basic_plane(spark):
    base = ["the quick brown fox jumps over it", "\U0001f94a\U0001f94b boxing night of the year two", "the quick brown fox jumped over us"]
    qs = ["teh quick brown fox jumps ovr it", "\U0001f94b\U0001f94a boxing night of the yeer two", "zz the quick brown fox jumped over us", "nobody at all"]
    got = {r["norm"]: (r["id"], r["ratio"]) for r in D.fuzzy_tier(
        frame(spark, [(q,) for q in qs], "norm string"), frame(spark, list(zip(base, range(3))), "norm string, id long")).collect()}
    best = {q: max((SequenceMatcher(None, q, c).ratio(), -i) for i, c in enumerate(base)) for q in qs}
    assert got == {q: (-i, r) for q, (r, i) in best.items() if r > 0.85} and len(got) == 3


def test_fuzzy_refuses_lossy_threshold(spark):
    with pytest.raises(ValueError):
        D.fuzzy_tier(frame(spark, [("a",)], "norm string"), frame(spark, [("b", 1)], "norm string, id long"), 0.5)


def test_aliases_in_either_direction(spark):
    canon = D.build_canonical(frame(spark, [("Ann Bee",), ("ann  bee",), ("Cee Dee",)], "n string"), "n")
    assert [(r["norm"], r["canonical_id"]) for r in canon.orderBy("norm").collect()] == [("ann bee", 1), ("cee dee", 2)]
    src = frame(spark, [("Ann Bee", "web")], "name string, source string")
    a = D.build_aliases(canon, src, {"annie": "ann bee", "cee dee": "ceedee"})
    assert sorted(map(tuple, a.collect())) == [("ann bee", "web", 1), ("annie", "known", 1), ("ceedee", "known", 2)]


def tables(spark):
    pool = [(1, m, 6000 + 100 * m, 100 * m + 7 * m * m, 10 * m + m % 3) for m in range(1, 30)]
    stats = {m: (s, p, o) for _, m, s, p, o in pool}

    def one(sid, contest, members, shown):
        t = [sum(stats[m][i] for m in members) for i in range(3)]
        return (sid, contest, 1, ":".join(map(str, shown)), *t)

    sets = [one(1, 10, [1, 2, 3], [1, 2, -1]), one(2, 10, [4, 5, 6, 7], [-1, 5, -1, 7]), one(3, 10, [1, 2, 3], [1, 2, 3]),
            one(4, 11, [1, 2, 3], [1, 2, -1]), one(5, 11, [8, 9], [8, 9])]
    s = frame(spark, sets, "set_id long, contest_id long, date int, set_key string, total_salary long, total_points long, total_own long")
    p = frame(spark, pool, "date int, member long, salary long, points long, own long")
    sets, known = X.split_sets(s)
    mem = known.join(p.drop("date"), "member").select("set_id", "member", "salary", "points", "own")
    return sets, known, p, X.residuals(sets, known, mem)


def test_repair_of_one_and_two(spark):
    sets, known, pool, res = tables(spark)
    assert [tuple(r) for r in X.one_missing_by_total(res, known, pool).collect()] == [("1:2:-1", 3)]
    assert [tuple(r) for r in X.one_missing_by_stats(res, known, pool).collect()] == [("1:2:-1", 3)]
    assert [tuple(r) for r in X.two_missing(res, known, pool).collect()] == [("-1:5:-1:7", 4, 6)]


def test_repair_needs_one_candidate(spark):
    sets, known, pool, res = tables(spark)
    twin = pool.where("member = 3").withColumn("member", F.lit(99).cast("long"))
    assert X.one_missing_by_total(res, known, pool.unionByName(twin)).count() == 0


def test_apply_repairs_drops_duplicate_of_complete_set(spark):
    sets, known, pool, res = tables(spark)
    fixes = frame(spark, [("1:2:-1", [3]), ("-1:5:-1:7", [4, 6])], "set_key string, fills array<long>")
    out, added = X.apply_repairs(sets, fixes)
    keys = {r["set_id"]: r["new_key"] for r in out.collect()}
    assert keys == {2: "4:5:6:7", 3: "1:2:3", 4: "1:2:3", 5: "8:9"}  # set 1 already exists complete in contest 10
    assert sorted(map(tuple, added.collect())) == [(2, 0, 4), (2, 2, 6), (4, 2, 3)]


def test_fix_partial_totals(spark):
    s = frame(spark, [(1, True, 12050), (2, True, 18000), (3, False, 12000)], "set_id int, repaired boolean, total_salary int")
    m = frame(spark, [(1, 12000, 18500), (2, 12000, 18000), (3, 12000, 18000)], "set_id int, known_salary int, full_salary int")
    assert {r["set_id"]: r["total_salary"] for r in X.fix_partial_totals(s, m).collect()} == {1: 18500, 2: 18000, 3: 12000}


def test_nested_quotes_skip_other_markets(spark):
    doc = ('{"id":"e1","commence_time":"2022-01-16T03:00:00Z","bookmakers":[{"key":"b1","title":"B","markets":[{"key":"h2h","outcomes":'
           '[{"name":"x","price":150},{"name":"y","price":-200}]},{"key":"spreads","outcomes":[{"name":"x","price":1},{"name":"y","price":1}]}]},'
           '{"key":"b2","markets":[{"key":"h2h","outcomes":[{"name":"x","price":100}]}]}]}')
    rows = M.parse_events(frame(spark, [(doc,)], "doc string"), "doc", []).collect()
    assert [(r["book"], r["side_a"], r["prob_a"]) for r in rows] == [("b1", "x", 0.4)]


def test_movement_needs_both_lines(spark):
    rows = [("e1", "opening", 0.4, 0.6), ("e1", "closing", 0.5, 0.5), ("e2", "closing", 0.3, 0.9)]
    c = frame(spark, rows, "event_id string, line_type string, prob_a double, prob_b double").withColumn("n_books", F.lit(1))
    got = M.line_movement(M.devig(c), ["event_id"]).select("event_id", "line_type", F.round("move_a", 6)).collect()
    assert sorted(map(tuple, got)) == [("e1", "closing", 0.1), ("e1", "opening", 0.1), ("e2", "closing", None)]


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    T.overwrite(frame(spark, [(1, 1.0, 10), (2, 2.0, 10), (3, 3.0, 11)], "k int, v double, d int"), path, ["d"])
    before = {p.name for p in (tmp_path / "t" / "d=11").glob("*.parquet")}
    T.upsert(spark, path, frame(spark, [(2, 9.0, 10), (4, 4.0, 10)], "k int, v double, d int"), ["k"], "d")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == [(1, 1.0), (2, 9.0), (3, 3.0), (4, 4.0)]
    assert {p.name for p in (tmp_path / "t" / "d=11").glob("*.parquet")} == before


def test_upsert_latest_batch_wins_and_keys_may_move(spark, tmp_path):
    path = str(tmp_path / "t")
    T.overwrite(frame(spark, [(1, 1.0, 10, 0), (2, 2.0, 11, 0), (3, 3.0, 12, 0)], "k int, v double, d int, batch int"), path, ["d"])
    new = frame(spark, [(1, 5.0, 12, 2), (1, 9.0, 10, 1), (2, 7.0, 12, 1)], "k int, v double, d int, batch int")
    for _ in range(2):  # a second run changes nothing
        T.upsert(spark, path, new, ["k"], "d", batch="batch")
        got = sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "d").collect())
        assert got == [(1, 5.0, 12), (2, 7.0, 12), (3, 3.0, 12)]
    assert not (tmp_path / "t" / "d=11").exists()


def test_two_sets_that_lack_the_same_pair(spark):
    res = frame(spark, [(1, "1:-1:-1", 1, 10, 2, 14000, 30, 7), (2, "2:-1:-1", 2, 10, 2, 14000, 30, 7)],
                "set_id int, set_key string, contest_id int, date int, n_missing int, r_salary int, r_points int, r_own int")
    known = frame(spark, [(1, 1), (2, 2)], "set_id int, member bigint")
    pool = frame(spark, [(10, 8, 6500, 10, 3), (10, 9, 7500, 20, 4), (10, 7, 7500, 20, 5)], "date int, member bigint, salary int, points int, own int")
    got = sorted(tuple(r) for r in X.two_missing(res, known, pool).collect())
    assert got == [("1:-1:-1", 8, 9), ("2:-1:-1", 8, 9)]


def test_fingerprint_ignores_order_not_content(spark):
    a = frame(spark, [(1, "x"), (2, "y")], "i int, s string")
    b = frame(spark, [(2, "y"), (1, "x")], "i int, s string").repartition(3)
    c = frame(spark, [(1, "x"), (2, "z")], "i int, s string")
    f = lambda d: tuple(T.fingerprint(d, "t").first())
    assert f(a) == f(b) != f(c)


def test_missing_columns_are_named(spark):
    with pytest.raises(T.MissingColumns, match="b"):
        T.require(spark.range(1), ["id", "b"])


def test_stream_merges_late_files_and_replays(spark, tmp_path):
    import datetime as dt
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    landing, target = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, Q.QUOTE).coalesce(1).write.mode("append").parquet(landing)
    put([("e", at(5), 1, 0.5), ("f", at(1), 9, 0.9)])
    Q.run_available(spark, landing, target, str(tmp_path / "p"))
    put([("e", at(9), 2, 0.6)])
    put([("e", at(1), 3, 0.4)])  # late file
    Q.run_available(spark, landing, target, str(tmp_path / "p"))
    Q.run_available(spark, landing, target, str(tmp_path / "p"))  # nothing new
    got = {r["event_id"]: (r["open_prob"], r["close_prob"]) for r in Q.read_lines(spark, target).collect()}
    assert got == {"e": (0.4, 0.6), "f": (0.9, 0.9)}


def test_pairs_of_targets_equal_brute_force_in_blocks(spark):
    rng = random.Random(3)
    pool = sorted({(d, m, rng.choice([6000, 6500, 7000, 10600, 10700]), rng.randint(0, 6), rng.randint(0, 3)) for d in (1, 2) for m in range(40)})
    pool += [(1, 50, 6500, 2, 2), (1, 51, 6500, 2, 2), (1, None, 6500, 2, 2)]  # equal amounts, and a member without a name
    targets = sorted({(d, s, p, o) for d in (1, 2, 3) for s in (12000, 13000, 13500, 17100, 17200) for p in range(0, 13, 3) for o in range(4)})
    want = {(*t, min(x[1], y[1]), max(x[1], y[1])) for t in targets for x in pool for y in pool
            if x[1] is not None and y[1] is not None and x[1] != y[1] and x[0] == y[0] == t[0] and x[2] + y[2] == t[1] and x[3] + y[3] == t[2]
            and x[4] + y[4] == t[3] and all(6000 <= z[2] <= 10600 for z in (x, y))}
    p = frame(spark, pool, "date int, member bigint, salary int, points int, own int")
    r = frame(spark, targets, "date int, r_salary int, r_points int, r_own int")
    for pool_block, target_block in ((1000, 1000), (9, 7)):
        rows = X.pairs_of_targets(r, p, pool_block, target_block).where("a <> b").collect()
        assert {(*x[:4], min(x[4:]), max(x[4:])) for x in rows} == want and want


def test_two_missing_writes_no_half_pairs(spark):
    """Every target would meet each of the date's members: 300 x 4,000 rows a step earlier."""
    pool = spark.range(4000).select(F.lit(1).alias("date"), F.col("id").alias("member"), F.lit(6000).alias("salary"),
                                    (F.col("id") * 7).alias("points"), (F.col("id") * F.col("id")).alias("own"))
    res = spark.range(300).select((F.col("id") + 9000).alias("set_id"), F.concat(F.lit("k"), "id").alias("set_key"), F.col("id").alias("contest_id"),
                                  F.lit(1).alias("date"), F.lit(2).alias("n_missing"), F.lit(12000).alias("r_salary"),
                                  ((2 * F.col("id") + 1) * 7).alias("r_points"), (F.col("id") * F.col("id") + (F.col("id") + 1) * (F.col("id") + 1)).alias("r_own"))
    known = frame(spark, [], "set_id long, member long")
    out = X.two_missing(res, known, pool)
    assert {(r["a"] + 1, r["b"]) for r in out.collect()} == {(i + 1, i + 1) for i in range(300)}
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().toString()


def test_one_missing_by_total_counts_before_it_lists(spark):
    cols = "set_id int, set_key string, contest_id int, date int, n_missing int, r_salary int"
    # set 1: three members at 7000, two of them known; set 2: three, one known; set 3: listed twice, once with too many
    res = frame(spark, [(1, "1:2:-1", 1, 10, 1, 7000), (2, "1:-1", 2, 10, 1, 7000), (3, "9:-1", 3, 10, 1, 7000), (3, "9:-1", 3, 11, 1, 8000),
                        (4, "-1", 4, 11, 1, 8000)], cols)
    known = frame(spark, [(1, 1), (1, 2), (2, 1), (3, 9)], "set_id int, member bigint")
    pool = frame(spark, [(10, 1, 7000), (10, 2, 7000), (10, 3, 7000), (11, 5, 8000)], "date int, member bigint, salary int")
    got = sorted(tuple(r) for r in X.one_missing_by_total(res, known, pool).collect())
    assert got == [("-1", 5), ("1:2:-1", 3)]


def test_repairs_read_the_lines_once_and_sum_sets_in_one_shuffle(spark, tmp_path):
    import datetime

    from ledgerfold.plans import people
    from ledgerfold.plans.registry import Tables

    day = datetime.datetime(2001, 2, 3)
    orders = [(3, 1, "F", 10.0, day, "1-URGENT"), (3, 2, "O", 20.0, day, "5-LOW"), (6, 1, "F", 10.0, day, "5-LOW")]
    lines = [(3, 11, 2), (3, 12, 1), (3, 11, 3), (6, None, 1), (6, 14, 2), (9, 15, 1)]
    frame(spark, orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
          ).write.parquet(f"{tmp_path}/orders.parquet")
    frame(spark, lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    sets, known, pool, res = people.set_tables(Tables(spark, str(tmp_path)))
    for df in (sets, known, pool, res):
        assert "l_partkey" not in df._jdf.queryExecution().analyzed().toString()
    # the order that is there twice counts twice, an unknown member adds nothing
    pay = lambda *ms: sum(6000 + m * 100 % 4700 for m in ms)
    assert sorted((r["set_id"], r["set_key"], r["total_salary"]) for r in sets.collect()) == [
        (3, "12:-1", 2 * pay(11, 12)), (3, "12:-1", 2 * pay(11, 12)), (6, "-1", pay(14))]
    # twice known, twice listed: four rows of the member
    assert {(r["set_id"], r["r_salary"]) for r in res.collect()} == {(3, 2 * pay(11, 12) - 4 * pay(12))}


def test_residuals_of_repeated_and_unlisted_members(spark):
    sets = frame(spark, [(1, 1, "a", 10, 0, 100, 100, 100), (2, 1, "b", 10, 0, 100, 100, 100), (3, 1, "c", 10, 0, 100, 100, 100)],
                 "set_id long, date int, set_key string, contest_id long, n_missing int, total_salary long, total_points long, total_own long")
    known = frame(spark, [(1, 7), (1, 7), (1, 8), (2, 7), (2, 9), (3, 7)], "set_id long, member long")
    stats = frame(spark, [(1, 7, 5, None, 1), (1, 8, 6, 2, 1), (1, 8, 6, 2, 1), (1, 6, 50, 50, 50), (2, 7, 5, 2, 1), (3, 7, None, 2, 1), (None, 7, 1, 1, 1), (3, None, 1, 1, 1)],
                  "set_id long, member long, salary long, points long, own long")
    got = X.residuals(sets, known, stats)
    assert [tuple(r) for r in got.collect()] == [(1, 1, "a", 10, 0, 100 - 22, 100 - 4, 100 - 4, X.CAP - 22)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # members do not meet their rows in a join of its own


def test_a_written_table_leaves_no_shuffle_files(spark):
    import pathlib

    from ledgerfold.session import materialize

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p.name for d in folders for p in pathlib.Path(d).rglob("shuffle_*")}
    before = files()
    written = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before
    assert sorted(r["count"] for r in written.collect()) == [142] + [143] * 6
    read = written.groupBy("count").agg(F.count("k").alias("n"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, read.collect())) == [(142, 1), (143, 6)]  # what is not written may run twice


def test_fixes_are_written_step_by_step_and_known_members_meet_candidates_once(spark, tmp_path):
    import datetime

    from ledgerfold.plans import people
    from ledgerfold.plans.registry import Tables

    day = datetime.datetime(2001, 2, 3)
    frame(spark, [(k, 1, "F", 10.0, day, "5-LOW") for k in (3, 4, 5)],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(3, 11, 1), (3, 12, 2), (4, 11, 1), (4, 12, 2), (4, 16, 3), (5, 17, 1)]
    frame(spark, lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    _, (out, added), _ = people.repaired(Tables(spark, str(tmp_path)))
    assert {(r["set_id"], r["new_key"]) for r in out.collect()} == {(3, "11:12"), (4, "11:12:16"), (5, "17")}
    assert sorted(tuple(r) for r in added.collect()) == [(3, 1, 12), (4, 1, 12), (4, 2, 16)]
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().toString()

    sets, known, pool, res = tables(spark)
    plan = X.two_missing(res, known, pool)._jdf.queryExecution()
    assert "LeftAnti" not in plan.optimizedPlan().toString()
    # a known member, and one that is not named, in either column
    cand = frame(spark, [(1, 7, 8), (1, 8, 9), (1, 9, None), (2, 7, 8), (None, 7, 7)], "set_id long, a long, b long")
    held = frame(spark, [(1, 7), (1, None), (None, 7), (2, 9)], "set_id long, member long")
    kept = X._without_known(cand, held, ("a", "b")).collect()
    assert {tuple(r) for r in kept} == {(1, 8, 9), (1, 9, None), (2, 7, 8), (None, 7, 7)}
