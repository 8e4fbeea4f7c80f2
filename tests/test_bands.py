"""Band edges, rules, tags, scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerfold import presets as P
from ledgerfold.functions import bands as B, scalars as S
from ledgerfold.operators import returns as R
from ledgerfold.operators.encode import LeakageError, assert_no_leakage, leaky

PRESETS = {k: v for k, v in vars(P).items() if isinstance(v, dict) and "edges" in v}


def by_hand(x, spec):
    if x is None or math.isnan(x):
        return None
    edges, right = spec["edges"], spec.get("closed", "right") == "right"
    for i, label in enumerate(spec["labels"]):
        lo, hi = edges[i], edges[i + 1]
        inside = (lo < x <= hi or (i == 0 and spec.get("include_lowest") and x == lo)) if right else lo <= x < hi
        if inside:
            return label
    return None


@pytest.mark.parametrize("name", sorted(PRESETS))
def test_every_edge(spark, name):
    spec = PRESETS[name]
    finite = [float(e) for e in spec["edges"] if math.isfinite(e)]
    xs = sorted({y for e in finite for y in (e, math.nextafter(e, -math.inf), math.nextafter(e, math.inf), e + 0.5, e - 0.5)})
    rows = [(x,) for x in [*xs, None, float("nan")]]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(B.apply_band("x", spec)).collect()]
    assert got == [by_hand(x, spec) for (x,) in rows]


def test_favourite_count_six_has_a_band(spark):
    df = spark.createDataFrame([(6,)], "favorite_count int")
    assert R.add_regime_columns(df).first()["fav_count_band"] == "6"


def test_regime_columns_only_where_inputs_exist(spark):
    df = R.add_regime_columns(spark.createDataFrame([(12,)], "fight_count int"))
    assert set(df.columns) == {"fight_count", "slate_size", "fight_count_band"}


def test_family_lookahead(spark):
    names = ["Hook & Jab", "The Left hook", "MINIMAX", "mini-max", "arm bar", "ArmBar", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(B.regex_family("n", P.FAMILIES)).collect()] == ["Other", "Hook", "Other", "mini-MAX", "Arm Bar", "Other", "Other"]


def test_archetypes(spark):
    caps = [None, 1, 2, 3, 18, 19, 20, 21, 150, 151]
    df = spark.createDataFrame([(c, 1000) for c in caps], "multi_entry_max int, contest_size int")
    got = [tuple(r) for r in df.select(R.archetype(), R.archetype(taxonomy="study"), R.archetype(taxonomy="mart")).collect()]
    assert [g[0] for g in got] == ["UNLIMITED", "SE"] + ["LIMITED"] * 5 + ["150-Max"] * 2 + ["UNLIMITED"]
    assert [g[1] for g in got] == ["UNLIMITED", "SE", "UNLIMITED", "LIMITED", "LIMITED", "UNLIMITED", "20-Max", "UNLIMITED", "150-Max", "UNLIMITED"]
    assert [g[2] for g in got] == ["MME", "Single Entry", "Limited", "3-Max", "Limited", "Limited", "20-Max", "MME", "150-Max", "MME"]


def test_names(spark):
    df = spark.createDataFrame([("T.J. X",), ("A-B",), ("  a   b ",), ("End.",)], "n string")
    assert [r[0] for r in df.select(S.normalize_name("n")).collect()] == ["tj x", "a b", "a b", "end"]
    r = spark.range(1).select(S.last_name(F.lit("jon van dam")), S.reversed_name(F.lit("a b")), S.reversed_name(F.lit("a b c"))).first()
    assert tuple(r) == ("dam", "b a", None)


def test_odds(spark):
    df = spark.createDataFrame([(150.0,), (-200.0,), (0.0,), (None,)], "o double")
    got = [r[0] for r in df.select(S.american_to_prob("o")).collect()]
    assert got[:3] == [0.4, pytest.approx(2 / 3), 0.5] and got[3] is None
    assert spark.range(1).select(S.kelly(F.lit(0.2), F.lit(-150.0))).first()[0] == 0.0


def test_dates(spark):
    r = spark.range(1).select(S.local_date_id(F.lit("2022-01-16T03:00:00Z")), S.local_date_id(F.lit("junk")), S.date_from_id(F.lit(20220115)),
                              S.date_from_id(F.lit(20221399))).first()
    assert r[0] == 20220115 and r[1] is None and str(r[2]) == "2022-01-15" and r[3] is None


def test_normal_functions(spark):
    from statistics import NormalDist
    ps = [0.001, 0.01, 0.024, 0.3, 0.5, 0.8, 0.98, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", S.normal_ppf("p").alias("z")).withColumn("c", S.normal_cdf("z"))
    for r in df.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-7) and r["c"] == pytest.approx(r["p"], abs=1e-6)


def test_fill_holes(spark):
    r = spark.range(1).select(S.fill_holes(S.members(F.lit("5:-1:7:-1")), F.array(F.lit(8), F.lit(9))), S.n_missing(F.lit("5:-1:7:-1"))).first()
    assert r[0] == [5, 8, 7, 9] and r[1] == 2


def test_predicate_rate_keeps_unknown_in_denominator(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,), (2.0,)], "x double")
    assert df.agg(B.rate(F.col("x") > 0)).first()[0] == 0.5


def test_leakage_guard():
    assert leaky([" Ownership ", "salary", "PAYOUT"]) == [" Ownership ", "PAYOUT"]
    assert len(leaky(P.LEAKY_COLUMNS)) == 9
    with pytest.raises(LeakageError):
        assert_no_leakage(["salary", "cashed"])
    with pytest.raises(LeakageError):
        assert_no_leakage(["my_result"], ["MY_RESULT"])
    assert_no_leakage(["salary"])
