"""Skill, exposure, entity resolution and set repair (K*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.functions import scalars as S
from ledgerfold.operators import identity as D, repair as X, skill as K
from ledgerfold.plans.registry import query, r6
from ledgerfold.plans.roles import players_table
from ledgerfold.session import materialize

SKILL = """
, cnt AS (SELECT user_id, count(*) AS n_entries, sum((status = 'F')::INT)::BIGINT AS n_cashes FROM contests GROUP BY 1 HAVING count(*) >= 5),
m AS (SELECT avg(n_cashes/n_entries) AS mu, var_pop(n_cashes/n_entries) AS v FROM cnt),
pr AS (SELECT greatest(mu*greatest(mu*(1-mu)/greatest(v, 1e-8) - 1, 0.1), 0.1) AS a0,
              greatest((1-mu)*greatest(mu*(1-mu)/greatest(v, 1e-8) - 1, 0.1), 0.1) AS b0 FROM m),
post AS (SELECT *, (a0 + n_cashes)/(a0 + b0 + n_entries) AS pm FROM cnt, pr),
ex AS (SELECT *, pm >= (SELECT quantile_cont(pm, 0.8) FROM post) - 1e-12 AS is_expert FROM post)
"""


def counts(t):
    return K.user_counts(t.contests.withColumn("won", F.col("status") == "F"), "user_id", "won", min_entries=5)


def experts(t):
    post = K.posterior_skill(counts(t))
    return post


@query("K01_beta_prior", SKILL + "SELECT round(a0, 6) AS alpha0, round(b0, 6) AS beta0 FROM pr")
def _(t):
    return K.beta_prior(counts(t)).select(r6("alpha0").alias("alpha0"), r6("beta0").alias("beta0"))


@query("K02_posterior_skill", SKILL + """
SELECT user_id, n_entries, n_cashes, round(n_cashes/n_entries, 6) AS cash_rate, round(pm, 6) AS posterior_mean, is_expert FROM ex""")
def _(t):
    return experts(t).select("user_id", "n_entries", "n_cashes", r6("cash_rate").alias("cash_rate"),
                             r6("posterior_mean").alias("posterior_mean"), "is_expert")


EXPO = SKILL + """
, mem AS (SELECT date_id, brand, contest_id, p.user_id, coalesce(is_expert, false) AS x FROM players p LEFT JOIN ex USING (user_id)),
per AS (SELECT date_id, brand, count(DISTINCT contest_id) AS f, count(DISTINCT CASE WHEN x THEN contest_id END) AS s,
        count(DISTINCT CASE WHEN x THEN user_id END) AS n_experts FROM mem GROUP BY 1, 2),
sig AS (SELECT *, f/greatest(sum(f) OVER (PARTITION BY date_id), 1)*100 AS fp, s/greatest(sum(s) OVER (PARTITION BY date_id), 1)*100 AS sp FROM per)
"""


def signals(t, members=None):
    ex = experts(t).where("is_expert").select("user_id")
    return K.exposure(t.players if members is None else members, ex, entity="brand", name="brand")


@query("K03_exposure", EXPO + """
SELECT date_id, brand, round(fp, 6) AS field_pct, round(sp, 6) AS expert_pct, round(sp - fp, 6) + 0.0::DOUBLE AS delta,
       round(least(n_experts/5, 1), 6) AS confidence, n_experts FROM sig""")
def _(t):
    s = signals(t)
    return s.select("date_id", "brand", *[r6(c).alias(c) for c in ("field_pct", "expert_pct", "delta", "confidence")], "n_experts")


@query("K04_exposure_interaction", EXPO + """
, j AS (SELECT CASE WHEN sp - fp > 1e-9 THEN 'experts_over' WHEN sp - fp < -1e-9 THEN 'experts_under' ELSE 'even' END AS exposure_side,
        (close_prob > 0.5)::INT AS is_favorite, actual_points, ownership FROM players JOIN sig USING (date_id, brand))
SELECT exposure_side, is_favorite, count(*) AS n, round(avg(actual_points), 6) AS avg_points, round(avg(ownership), 6) AS avg_own FROM j GROUP BY 1, 2""")
def _(t):
    # members and signals are written once each; what was shuffled for them is gone before the next step
    members = players_table(t, "date_id", "brand", "user_id", "contest_id", "close_prob", "actual_points", "ownership")
    perf = members.withColumn("is_favorite", (F.col("close_prob") > 0.5).cast("int"))
    s = K.exposure_interaction(materialize(signals(t, members), "signals"), perf, keys=("date_id", "brand"), band=1e-9)
    return s.select("exposure_side", "is_favorite", "n", r6("avg_points").alias("avg_points"), r6("avg_own").alias("avg_own"))


# ---- names -----------------------------------------------------------------
_NORM = r"trim(regexp_replace(replace(replace(lower({0}), '-', ' '), '.', ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
NAMES = f"""
, nm AS (SELECT 2*p_partkey AS name_id, 'part' AS source, p_name AS display FROM part
       UNION ALL SELECT 2*s_suppkey + 1, 'supplier', s_name FROM supplier),
nn AS (SELECT *, {_NORM.format('display')} AS norm FROM nm),
canon AS (SELECT norm, min(display) AS display, row_number() OVER (ORDER BY encode(norm)) AS canonical_id FROM nn WHERE norm <> '' GROUP BY norm),
qs AS (SELECT name_id, CASE name_id % 5 WHEN 0 THEN norm WHEN 1 THEN CASE WHEN len(string_split(norm, ' ')) = 2 THEN split_part(norm, ' ', 2) || ' ' || split_part(norm, ' ', 1) ELSE norm END
       WHEN 2 THEN 'zz ' || split_part(norm, ' ', -1) WHEN 3 THEN substr(norm, 2) ELSE 'aka ' || norm END AS norm FROM nn),
al AS (SELECT 'aka ' || norm AS alias, min(canonical_id) AS id FROM nn JOIN canon USING (norm) WHERE name_id % 10 = 4 GROUP BY 1),
ln AS (SELECT split_part(norm, ' ', -1) AS k, min(canonical_id) AS id FROM canon GROUP BY 1 HAVING count(DISTINCT canonical_id) = 1),
mt AS (SELECT q.norm, CASE WHEN len(string_split(q.norm, ' ')) = 2 THEN split_part(q.norm, ' ', 2) || ' ' || split_part(q.norm, ' ', 1) END AS rv,
       c.canonical_id AS i1, al.id AS i2, ln.id AS i3 FROM (SELECT DISTINCT norm FROM qs) q LEFT JOIN canon c USING (norm)
       LEFT JOIN al ON al.alias = q.norm LEFT JOIN ln ON ln.k = split_part(q.norm, ' ', -1)),
tiers AS (SELECT mt.norm, coalesce(i1, i2, i3, c.canonical_id) AS id, CASE WHEN i1 IS NOT NULL THEN 'exact' WHEN i2 IS NOT NULL THEN 'alias'
          WHEN i3 IS NOT NULL THEN 'last_name' WHEN c.canonical_id IS NOT NULL THEN 'reversed' END AS method FROM mt LEFT JOIN canon c ON c.norm = mt.rv)
"""


def names(t):
    """Whole part and supplier names, one row per named row."""
    parts = t.part.select((2 * F.col("p_partkey")).alias("name_id"), F.lit("part").alias("source"), F.col("p_name").alias("display"))
    supp = t.supplier.select((2 * F.col("s_suppkey") + 1).alias("name_id"), F.lit("supplier").alias("source"), F.col("s_name").alias("display"))
    return parts.unionByName(supp).withColumn("norm", S.normalize_name("display"))


def canon(t):
    return D.build_canonical(names(t), "display")


def name_queries(t):
    n, k = F.col("norm"), F.col("name_id") % 5
    return names(t).select("name_id", F.when(k == 0, n).when(k == 1, F.coalesce(S.reversed_name("norm"), n)).when(
        k == 2, F.concat(F.lit("zz "), S.last_name("norm"))).when(k == 3, F.expr("substr(norm, 2)")).otherwise(
        F.concat(F.lit("aka "), n)).alias("norm"))


def name_aliases(t, c):
    return names(t).where("name_id % 10 = 4").join(c.select("norm", F.col("canonical_id").alias("id")), "norm").select(
        F.concat(F.lit("aka "), "norm").alias("alias"), "id")


def tiers(t, c=None):
    c = canon(t) if c is None else c
    return D.match_exact_tiers(name_queries(t), c.select("norm", F.col("canonical_id").alias("id")), name_aliases(t, c))


@query("E01_canonical_names", NAMES + "SELECT norm, display, canonical_id FROM canon")
def _(t):
    return canon(t).select("norm", "display", "canonical_id")


@query("E02_aliases", NAMES + """
, direct AS (SELECT DISTINCT norm AS alias, source FROM nn),
known AS (SELECT * FROM (VALUES ('red small', 'small ring'), ('aka nobody', 'nobody known')) v(a, b)),
al2 AS (SELECT alias, source, canonical_id FROM direct JOIN canon ON canon.norm = alias
        UNION ALL SELECT a, 'known', canonical_id FROM known JOIN canon ON norm = b
        UNION ALL SELECT b, 'known', canonical_id FROM known JOIN canon ON norm = a)
SELECT alias, source, min(canonical_id) AS canonical_id FROM al2 GROUP BY 1, 2""")
def _(t):
    src = names(t).select(F.col("display").alias("name"), "source")
    return D.build_aliases(canon(t), src, {"red small": "small ring", "aka nobody": "nobody known"})


@query("E03_match_exact_tiers", NAMES + "SELECT norm, id, method FROM tiers")
def _(t):
    return tiers(t)


@query("E04_match_report_with_fuzzy")
def _(t):
    return D.match_report(match_names(t)).select("method", "n", r6("share").alias("share"))


@query("J13_unmatched_after_fuzzy")
def _(t):
    return D.unmatched(name_queries(t), match_names(t))


@query("E03_match_names_with_fuzzy")
def match_names(t):
    c = canon(t)
    return D.match_names(name_queries(t), c.select("norm", F.col("canonical_id").alias("id")), name_aliases(t, c))


@query("E04_match_report", NAMES + """
SELECT coalesce(method, 'none') AS method, count(*) AS n, round(count(*)/(SELECT count(*) FROM tiers), 6) AS share FROM tiers GROUP BY 1""")
def _(t):
    return D.match_report(tiers(t).fillna("none", ["method"])).select("method", "n", r6("share").alias("share"))


@query("J13_unmatched_names", NAMES + """
SELECT DISTINCT norm FROM qs WHERE norm NOT IN (SELECT norm FROM tiers WHERE id IS NOT NULL)""")
def _(t):
    return D.unmatched(name_queries(t), tiers(t))


@query("E04_learned_aliases", NAMES + """
SELECT alias, 'seen' AS source, min(id) AS id FROM (SELECT alias, id FROM al UNION ALL SELECT norm, id FROM tiers WHERE id IS NOT NULL) GROUP BY 1""")
def _(t):
    c = canon(t)
    return D.learn_aliases(name_aliases(t, c).withColumn("source", F.lit("seen")), tiers(t, c), "seen")


@query("E05_fuzzy_tier")
def _(t):
    c = canon(t).select("norm", F.col("canonical_id").alias("id"))
    d = D.fuzzy_tier(name_queries(t), c)
    return d.select("norm", "id", r6("ratio").alias("ratio"))


# ---- set repair --------------------------------------------------------------
SETS = """
, sd AS (SELECT l_orderkey AS set_id, l_partkey AS member, min(l_linenumber) AS slot FROM lineitem GROUP BY 1, 2),
me AS (SELECT set_id, member, row_number() OVER w AS rk, count(*) OVER (PARTITION BY set_id) AS n, day_id AS date,
       6000 + (member*100) % 4700 AS salary, (member*7919) % 20011 AS points, (member*104729) % 5003 AS own
       FROM sd JOIN contests ON contest_id = set_id WINDOW w AS (PARTITION BY set_id ORDER BY slot, member)),
hd AS (SELECT *, CASE WHEN set_id % 3 = 0 AND n >= 2 THEN 1 WHEN set_id % 3 = 1 AND n >= 3 THEN 2 ELSE 0 END AS h FROM me),
kn AS (SELECT set_id, member FROM hd WHERE rk <= n - h),
st AS (SELECT set_id, date, max(h) AS n_missing, sum(salary) AS ts, sum(points) AS tp, sum(own) AS tw,
       string_agg(CASE WHEN rk <= n - h THEN member::VARCHAR ELSE '-1' END, ':' ORDER BY rk) AS set_key,
       sum(salary) FILTER (rk <= n-h) AS ks, sum(points) FILTER (rk <= n-h) AS kp, sum(own) FILTER (rk <= n-h) AS ko FROM hd GROUP BY 1, 2),
rs AS (SELECT *, ts-ks AS rsal, tp-kp AS rpts, tw-ko AS rown, 50000-ks AS room FROM st),
pool AS (SELECT DISTINCT date, member, salary, points, own FROM me),
f1 AS (SELECT set_id, set_key, min(member) AS member FROM (
         SELECT r.set_id, set_key, p.member FROM rs r JOIN pool p ON p.date = r.date AND p.salary = r.rsal
         WHERE n_missing = 1 AND rsal BETWEEN 6000 AND 10600 AND (r.set_id, p.member) NOT IN (SELECT set_id, member FROM kn)) GROUP BY 1, 2 HAVING count(*) = 1),
f2 AS (SELECT set_id, set_key, min(member) AS member FROM (
         SELECT r.set_id, set_key, p.member FROM rs r JOIN pool p ON p.date = r.date AND p.points = r.rpts AND p.own = r.rown
         WHERE n_missing = 1 AND p.salary <= room AND (r.set_id, p.member) NOT IN (SELECT set_id, member FROM kn)) GROUP BY 1, 2 HAVING count(*) = 1),
f3 AS (SELECT set_id, set_key, min(a) AS a, min(b) AS b FROM (
         SELECT r.set_id, set_key, p.member AS a, q.member AS b FROM rs r JOIN pool p ON p.date = r.date
         JOIN pool q ON q.date = r.date AND q.salary = rsal - p.salary AND q.points = rpts - p.points AND q.own = rown - p.own AND q.member > p.member
         WHERE n_missing = 2 AND rsal BETWEEN 12000 AND 21200 AND p.salary BETWEEN 6000 AND 10600 AND q.salary BETWEEN 6000 AND 10600
           AND (r.set_id, p.member) NOT IN (SELECT set_id, member FROM kn) AND (r.set_id, q.member) NOT IN (SELECT set_id, member FROM kn))
       GROUP BY 1, 2 HAVING count(*) = 1)
"""


def stat_columns(member="member"):
    m = F.col(member) if isinstance(member, str) else member
    return {"salary": 6000 + (m * 100) % 4700, "points": (m * 7919) % 20011, "own": (m * 104729) % 5003}


def set_rows(t):
    """All members of each order, in line order, with one or two of them hidden, and the totals of all.

    A set is a value of its own (a delimited key), so its members meet in one row.
    """
    li = t.lineitem.select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("member"), "l_linenumber").repartition("set_id")
    m = li.groupBy("set_id", "member").agg(F.min("l_linenumber").alias("slot"))  # rows are hardly ever alike: one shuffle, by set
    s = m.groupBy("set_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "member"))), lambda x: x["member"]).alias("arr"))
    n, k = F.size("arr"), F.col("set_id") % 3
    hide = F.when((k == 0) & (n >= 2), 1).when((k == 1) & (n >= 3), 2).otherwise(0)
    c = t.contests.select(F.col("contest_id").alias("set_id"), F.col("day_id").alias("date"))
    s = s.join(c, "set_id").withColumn("h", hide)
    key = F.array_join(F.transform("arr", lambda x, i: F.when(i < F.size("arr") - F.col("h"), x).otherwise(F.lit(-1))).cast("array<string>"), ":")
    # a set listed twice counts twice, as each of its rows holds all members; unknown members add nothing
    once = F.filter("arr", lambda x: x.isNotNull())
    total = lambda c: F.when(F.size(once) > 0, F.aggregate(F.transform(once, lambda x: stat_columns(x)[c]), F.lit(0).cast("long"), lambda a, x: a + x))
    by_set = Window.partitionBy("set_id")  # one row, or as many as the contest has
    return s.select("set_id", "date", "arr", key.alias("set_key"), F.col("set_id").alias("contest_id"),
                    *[F.sum(total(c)).over(by_set).alias(f"total_{c}") for c in ("salary", "points", "own")])


def set_tables(t):
    """(sets, known, pool, residuals); the rows they all come from, the pool and the residuals are built and written once."""
    s = materialize(set_rows(t), "sets")
    mem = s.select("set_id", "date", F.explode("arr").alias("member")).withColumns(stat_columns())
    pool = materialize(mem.select("date", "member", "salary", "points", "own").distinct(), "pool")
    sets, known = X.split_sets(s.drop("arr"))
    res = materialize(X.residuals(sets, known, mem.select("set_id", "member", "salary", "points", "own")), "residuals")
    return sets, known, pool, res


@query("E06_repair_one_by_total", SETS + "SELECT set_key, min_by(member, set_id) AS member FROM f1 GROUP BY 1")
def _(t):
    _, known, pool, res = set_tables(t)
    return X.one_missing_by_total(res, known, pool)


@query("E07_repair_one_by_stats", SETS + "SELECT set_key, min_by(member, set_id) AS member FROM f2 GROUP BY 1")
def _(t):
    _, known, pool, res = set_tables(t)
    return X.one_missing_by_stats(res, known, pool)


@query("E08_repair_two_missing", SETS + "SELECT set_key, min_by(a, set_id) AS a, min_by(b, set_id) AS b FROM f3 GROUP BY 1")
def _(t):
    _, known, pool, res = set_tables(t)
    return X.two_missing(res, known, pool)


FIXED = SETS + """
, fx AS (SELECT set_key, [min_by(member, set_id)] AS fills FROM f2 GROUP BY 1
         UNION ALL SELECT set_key, [min_by(a, set_id), min_by(b, set_id)] FROM f3 GROUP BY 1)
"""


def repaired(t):
    sets, known, pool, res = set_tables(t)
    # one after the other: what one step shuffled is gone when the next begins
    ones = materialize(X.one_missing_by_stats(res, known, pool).select("set_key", F.array("member").alias("fills")), "ones")
    twos = materialize(X.two_missing(res, known, pool).select("set_key", F.array("a", "b").alias("fills")), "twos")
    fixes = ones.unionByName(twos)
    return sets, X.apply_repairs(sets, fixes), res


@query("E09_apply_repairs", FIXED + """
, sp AS (SELECT set_id, set_key, unnest(string_split(set_key, ':')) AS tok, generate_subscripts(string_split(set_key, ':'), 1) AS i, fills FROM st LEFT JOIN fx USING (set_key)),
nk AS (SELECT *, sum((tok = '-1')::INT) OVER (PARTITION BY set_id ORDER BY i) AS hole FROM sp)
SELECT set_id, string_agg(CASE WHEN tok = '-1' AND fills IS NOT NULL THEN fills[hole::INT]::VARCHAR ELSE tok END, ':' ORDER BY i) AS new_key,
       any_value(fills) IS NOT NULL AS repaired FROM nk GROUP BY 1""")
def _(t):
    _, (out, _), _ = repaired(t)
    return out.select("set_id", "new_key", "repaired")


@query("E09_added_members", FIXED + """
, sp AS (SELECT set_id, unnest(string_split(set_key, ':')) AS tok, generate_subscripts(string_split(set_key, ':'), 1) AS i, fills FROM st JOIN fx USING (set_key)),
nk AS (SELECT *, sum((tok = '-1')::INT) OVER (PARTITION BY set_id ORDER BY i) AS hole FROM sp)
SELECT set_id, (i-1)::INT AS slot, fills[hole::INT] AS member FROM nk WHERE tok = '-1'""")
def _(t):
    return repaired(t)[1][1]


@query("E09_partial_totals", FIXED + """
SELECT set_id, CASE WHEN set_id % 2 = 0 AND fills IS NULL THEN ks ELSE ts END::BIGINT AS total_salary FROM st LEFT JOIN fx USING (set_key)""")
def _(t):
    """Every second set arrives with a total that covers its known members only."""
    sets, (out, _), res = repaired(t)
    totals = res.join(sets.select("set_id", F.col("total_salary").alias("full_salary")), "set_id").select(
        "set_id", (F.col("full_salary") - F.col("r_salary")).alias("known_salary"), "full_salary")
    known = totals.select("set_id", F.col("known_salary").alias("_known"))
    flawed = out.join(known, "set_id").withColumn("total_salary", F.when(F.col("set_id") % 2 == 0, F.col("_known")).otherwise(F.col("total_salary")))
    return X.fix_partial_totals(flawed, totals).select("set_id", "total_salary")


@query("E10_completeness", FIXED + """
SELECT 'before' AS stage, n_missing::INT AS n_missing, count(*) AS n_sets FROM st GROUP BY 2
UNION ALL SELECT 'after', CASE WHEN fills IS NOT NULL THEN 0 ELSE n_missing END::INT, count(*) FROM st LEFT JOIN fx USING (set_key) GROUP BY 2""")
def _(t):
    sets, (out, _), _ = repaired(t)
    return X.completeness(sets).withColumn("stage", F.lit("before")).unionByName(
        X.completeness(out, "new_key").withColumn("stage", F.lit("after")))


@query("F14_set_strings", SETS + """
SELECT set_id, set_key, n_missing::INT AS n_missing, replace(set_key, '-1', 'x') AS shown FROM st""")
def _(t):
    sets, _ = X.split_sets(set_rows(t))
    shown = F.array_join(F.transform(S.members("set_key"), lambda x: F.when(x == -1, F.lit("x")).otherwise(x.cast("string"))), ":")
    return sets.select("set_id", "set_key", "n_missing", shown.alias("shown"))


@query("P03_complete_sets_only", SETS + "SELECT set_id, set_key FROM st WHERE n_missing = 0")
def _(t):
    sets, _ = X.split_sets(set_rows(t))
    return sets.where(~F.array_contains(F.split("set_key", ":"), "-1")).select("set_id", "set_key")
