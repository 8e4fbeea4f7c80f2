"""Entity resolution: canonical names, aliases, five-tier matching."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ledgerfold import presets as P
from ledgerfold.functions import scalars as S
from ledgerfold.operators import ordered as O
from ledgerfold.operators.ordered import attach_row
from ledgerfold.session import materialize


def build_canonical(names: DataFrame, col: str) -> DataFrame:
    """(norm, display, canonical_id): ids follow the sorted normalised name.

    The id is a distributed row number: no global sort in one task.
    """
    u = names.where(F.col(col).isNotNull()).groupBy(S.normalize_name(col).alias("norm")).agg(F.min(col).alias("display"))
    return O.running(u.where("norm <> ''"), [], ["norm"], number="canonical_id")


def build_aliases(canon: DataFrame, sources: DataFrame, known: Mapping[str, str] = P.KNOWN_ALIASES) -> DataFrame:
    """(alias, source, canonical_id), unique on (alias, source).

    ``sources`` has (name, source).  A known pair is applied in whichever
    direction its target exists.
    """
    spark = canon.sparkSession
    direct = sources.select(S.normalize_name("name").alias("alias"), "source").distinct().join(
        canon.select(F.col("norm").alias("alias"), "canonical_id"), "alias")
    pairs = spark.createDataFrame([(a, b) for a, b in known.items()], "a string, b string")
    both = pairs.select(F.col("a").alias("alias"), F.col("b").alias("norm")).unionByName(
        pairs.select(F.col("b").alias("alias"), F.col("a").alias("norm")))
    extra = both.join(canon.select("norm", "canonical_id"), "norm").select(
        "alias", F.lit("known").alias("source"), "canonical_id")
    return direct.select("alias", "source", "canonical_id").unionByName(extra).groupBy("alias", "source").agg(
        F.min("canonical_id").alias("canonical_id"))


def _unique_last(cands: DataFrame) -> DataFrame:
    """Last names that belong to exactly one id (ids counted, not spellings)."""
    return cands.groupBy(S.last_name("norm").alias("_key")).agg(
        F.countDistinct("id").alias("_n"), F.min("id").alias("_id")).where("_n = 1").select("_key", "_id")


def match_exact_tiers(queries: DataFrame, cands: DataFrame, aliases: DataFrame) -> DataFrame:
    """exact -> alias -> unique last name -> reversed; NULL id where none fits.

    ``queries`` (norm), ``cands`` (norm, id), ``aliases`` (alias, id).  Right
    sides are unique per key, so each join is N:1 and adds no rows.
    """
    q = queries.select("norm").where("norm is not null").distinct()
    uniq = lambda d, k: d.groupBy(F.col(k).alias("_key")).agg(F.min("id").alias("_id"))
    tiers = [("exact", F.col("norm"), uniq(cands, "norm")), ("alias", F.col("norm"), uniq(aliases, "alias")),
             ("last_name", S.last_name("norm"), _unique_last(cands)), ("reversed", S.reversed_name("norm"), uniq(cands, "norm"))]
    found = q
    for name, key, table in tiers:
        found = found.withColumn("_k", key).join(
            table.select(F.col("_key").alias("_k"), F.col("_id").alias(f"_id_{name}")), "_k", "left").drop("_k")
    method = None
    for name, *_ in tiers:
        hit = F.col(f"_id_{name}").isNotNull()
        method = F.when(hit, name) if method is None else method.when(hit, name)
    return found.select("norm", F.coalesce(*[F.col(f"_id_{n}") for n, *_ in tiers]).alias("id"), method.alias("method"))


# --- fuzzy tier -----------------------------------------------------------

def matched_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio ``2M/T`` of two string columns."""
    from difflib import SequenceMatcher
    m = SequenceMatcher(None, autojunk=True)
    out, last = [], None
    for x, y in zip(a, b):
        if y != last:
            m.set_seq2(y)
            last = y
        m.set_seq1(x)
        out.append(m.ratio())
    return pd.Series(out)


similarity = F.pandas_udf(matched_ratio, T.DoubleType())


def _max_edits(la: Column, lb: Column, threshold: float) -> Column:
    """Largest number of unmatched characters a pair above the threshold has."""
    return F.ceil((1 - F.lit(threshold)) * (la + lb) - 1e-9).cast("int") - 1


GRAMS = (1, 2, 3, 5, 8)


VARIANTS = 200  # most spellings of one name with characters left out


def _grams(text: str, length: Column) -> Column:
    """Rows (g, at, gram): every substring of the lengths :data:`GRAMS`."""
    def of_length(g):
        at = lambda i: F.struct(F.lit(g).alias("g"), i.alias("at"), F.substring(F.col(text), i, F.lit(g)).alias("gram"))
        return F.when(length >= g, F.transform(F.sequence(F.lit(1), F.greatest(length - g + 1, F.lit(1))), at))

    return F.explode(F.flatten(F.filter(F.array(*map(of_length, GRAMS)), lambda x: x.isNotNull())))


def _ways(n: Column, k: Column) -> Column:
    """Number of ways to leave ``k`` of ``n`` characters out."""
    return F.aggregate(F.sequence(F.lit(0), k), F.lit(1.0), lambda w, i: F.when(i == 0, w).otherwise(w * (n - i + 1) / i))


def _left_out(text: Column, k: Column) -> Column:
    """Hashes of all spellings of ``text`` with exactly ``k`` characters left out."""
    def fewer(s):
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    all_ = F.aggregate(F.array_repeat(F.lit(0), k), F.array(text), lambda acc, _: F.array_distinct(F.flatten(F.transform(acc, fewer))))
    return F.transform(all_, lambda s: F.xxhash64(s))


def _signature(text: str) -> Column:
    """64 bits, one or more per (character, occurrence).

    Two texts differ in at most as many bits as their characters, counted as
    multisets, do.
    """
    chars = F.filter(F.split(F.col(text), ""), lambda ch: ch != "")
    nth = F.transform(chars, lambda ch, i: F.pmod(F.xxhash64(ch, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda y: y == ch))), F.lit(64)))
    return F.aggregate(nth, F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.cast("int"))))


def index_names(cands: DataFrame) -> DataFrame:
    """The distinct candidate names, written once: (cand, lc, sig_c)."""
    c = cands.select(F.col("norm").alias("cand")).distinct().withColumn("lc", F.length("cand")).withColumn("sig_c", _signature("cand"))
    return materialize(c, "cands")


def _budgets(queries: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """A row per query and length of candidates that can exceed the threshold, written once.

    ``out`` and ``ins`` are the most characters without a partner in the query
    and in a candidate of that length.  Characters that no candidate of the
    length has are among the first; ``kept`` is the query without them and
    ``free`` what is left of ``out``.  ``few`` tells that both sides have at
    most :data:`VARIANTS` spellings with that many characters left out.
    """
    la, lc, out, free, ins = (F.col(c) for c in ("la", "lc", "out", "free", "ins"))
    chars = F.filter(F.split("cand", ""), lambda ch: ch != "")
    lengths = index.select("lc", F.explode(chars).alias("ch")).groupBy("lc").agg(F.collect_set("ch").alias("letters"))
    q = queries.select("norm").where("norm is not null and norm <> ''").distinct().withColumn("la", F.length("norm"))
    low = F.greatest(F.ceil(la * F.lit(threshold / (2 - threshold))).cast("int"), F.lit(1))
    high = F.greatest(F.floor(la * F.lit((2 - threshold) / threshold)).cast("int"), low)
    q = q.withColumns({"sig": _signature("norm"), "lc": F.explode(F.sequence(low, high))})
    # one row per length of a name
    q = q.join(F.broadcast(lengths), "lc").withColumn("most", _max_edits(la, lc, threshold))
    q = q.withColumn("out", F.floor((F.col("most") + la - lc) / 2).cast("int")).withColumn("ins", out + lc - la).where((out >= 0) & (ins >= 0))
    kept = F.array_join(F.filter(F.split("norm", ""), lambda ch: F.array_contains("letters", ch)), "")
    q = q.withColumn("kept", kept).withColumn("free", out - (la - F.length("kept"))).where(free >= 0)
    few = (_ways(F.length("kept"), free) <= VARIANTS) & (_ways(lc, ins) <= VARIANTS)
    return materialize(q.withColumn("few", few).drop("letters"), "budgets")


def _by_spelling(plan: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs that become equal when each side leaves out what it may: exact for common subsequences."""
    used = plan.select("lc", "ins").distinct()
    left = plan.select("norm", "la", "lc", "ins", F.explode(_left_out(F.col("kept"), F.col("free"))).alias("key"))
    right = index.join(F.broadcast(used), "lc").select("cand", "lc", "ins", F.explode(_left_out(F.col("cand"), F.col("ins"))).alias("key"))
    return left.join(right, ["lc", "ins", "key"]).select("norm", "cand", "la", "lc")


def _by_grams(plan: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs that share one of the query's rarest substrings near the same place."""
    la, free, ins = F.col("la"), F.col("free"), F.col("ins")
    grams = index.join(F.broadcast(plan.select("lc").distinct()), "lc").select("cand", "lc", "sig_c", _grams("cand", F.col("lc")).alias("x")).select(
        "x.g", "x.gram", "cand", "lc", F.col("x.at").alias("at_c"), "sig_c")
    often = grams.groupBy("lc", "g", "gram").agg(F.count(F.lit(1)).alias("n"))
    mine = plan.select("norm", "kept", "la", "lc", "out", "free", "ins", "most", "sig", _grams("norm", la).alias("x")).select(
        "norm", "la", "lc", "out", "ins", "most", "sig", "x.g", "x.at", "x.gram",
        (F.col("x.g") * free + (F.col("x.g") - 1) * ins + 1).alias("need"),
        # a substring with a letter that no candidate has is spoilt already
        (F.length(F.call_function("translate", F.col("x.gram"), F.col("kept"), F.lit(""))) == 0).alias("whole")).where("whole")
    mine = mine.join(often, ["lc", "g", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # one name's substrings: bounded by its length
    one = Window.partitionBy("norm", "lc", "g")
    mine = mine.withColumns({"_r": F.row_number().over(one.orderBy("n", "at")), "_all": F.count(F.lit(1)).over(one)}).where("_all >= need and _r <= need")
    cost = mine.withColumn("_cost", F.sum("n").over(one))
    best = F.min(F.struct("_cost", "g")).over(Window.partitionBy("norm", "lc"))
    chosen = cost.withColumn("_best", best).where((F.col("_best.g") == F.col("g")) & (F.col("n") > 0))
    near = ((F.col("at_c") - F.col("at")).between(-F.col("out"), ins) & (F.bit_count(F.col("sig").bitwiseXOR(F.col("sig_c"))) <= F.col("most")))
    left, right = chosen.select("lc", "g", "gram", "norm", "la", "out", "ins", "most", "at", "sig").alias("l"), grams.alias("r")
    same = (F.col("l.lc") == F.col("r.lc")) & (F.col("l.g") == F.col("r.g")) & (F.col("l.gram") == F.col("r.gram"))
    return left.join(right, same & near).select("norm", "cand", "la", "l.lc")


def blocked_pairs(queries: DataFrame, cands: DataFrame, threshold: float, index: DataFrame | None = None) -> DataFrame:
    """All (norm, cand) pairs that can exceed ``threshold``, by equi join.

    A ratio above t leaves fewer than (1-t)(|a|+|b|) characters unmatched, which
    for a length of the candidates tells how many each side has at most.  Where
    that leaves few spellings, both sides bring their spellings with so many
    characters left out: the pairs with a long enough common subsequence agree
    in one, and no others.  Elsewhere an unmatched character spoils at most g of
    the query's substrings of length g (g - 1, if it stands in the candidate),
    so among one more of them than can be spoilt one occurs in the candidate,
    shifted by no more than that number of characters; a query brings its rarest
    ones, of the length that meets the fewest candidates.  Lossless, and never
    the cross product.
    """
    if threshold < 2 / 3:
        raise ValueError("the gram join is lossless only for thresholds of two thirds and more")
    index = index_names(cands) if index is None else index
    plan = _budgets(queries, index, threshold)
    pairs = _by_spelling(plan.where("few"), index).unionByName(_by_grams(plan.where("not few"), index)).distinct()
    # cheap exact bound before Python: common characters as multisets
    return pairs.where(2 * _common_chars("norm", "cand") > threshold * (F.col("la") + F.col("lc"))).select("norm", "cand")


def _common_chars(a: str, b: str) -> Column:
    """Size of the multiset intersection of two strings' characters."""
    chars = F.array_distinct(F.split(F.col(a), ""))
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, ch, F.lit("")))
    per = F.transform(F.filter(chars, lambda ch: ch != ""), lambda ch: F.least(count(F.col(a), ch), count(F.col(b), ch)))
    return F.aggregate(per, F.lit(0), lambda x, y: x + y)


def fuzzy_tier(queries: DataFrame, cands: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Best candidate strictly above the threshold: (norm, id, ratio).

    Near matches are looked for first: a name that has a candidate above 0.95
    needs no other, and the join for a high threshold is far more selective.
    """
    index = index_names(cands)
    ids = cands.groupBy(F.col("norm").alias("cand")).agg(F.min("id").alias("id"))
    rest, out = materialize(queries.select("norm").distinct(), "names"), None  # used once per round
    for t in sorted({threshold, (threshold + max(threshold, 0.95)) / 2, max(threshold, 0.95)}, reverse=True):
        pairs = blocked_pairs(rest, cands, t, index).repartition("norm", "cand").withColumn("ratio", similarity("norm", "cand"))
        hits = pairs.where(F.col("ratio") > t).join(ids, "cand")
        best = hits.groupBy("norm").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "id")).alias("m"))
        found = materialize(best.select("norm", F.col("m.id").alias("id"), (-F.col("m.r")).alias("ratio")), "fuzzy")
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select("norm"), "norm", "left_anti")
    return out


def match_names(queries: DataFrame, cands: DataFrame, aliases: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(norm, id, method) for every distinct query name."""
    first = match_exact_tiers(queries, cands, aliases)
    fuzzy = fuzzy_tier(first.where("id is null").select("norm"), cands, threshold)
    j = first.join(fuzzy.select("norm", F.col("id").alias("_f")), "norm", "left")
    return j.select("norm", F.coalesce("id", "_f").alias("id"), F.coalesce(
        F.col("method"), F.when(F.col("_f").isNotNull(), "fuzzy"), F.lit("unmatched")).alias("method"))


def match_report(matches: DataFrame) -> DataFrame:
    """Counts and shares by method."""
    by = matches.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return by.transform(attach_row, by.agg(F.sum("n").alias("total"))).select("method", "n", (F.col("n") / F.col("total")).alias("share"))


def unmatched(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Query names with no entity."""
    return queries.select("norm").distinct().join(matches.where("id is not null").select("norm"), "norm", "left_anti")


def learn_aliases(aliases: DataFrame, matches: DataFrame, source: str) -> DataFrame:
    """Feed matched spellings back as aliases."""
    new = matches.where("id is not null").select(F.col("norm").alias("alias"), F.lit(source).alias("source"), "id")
    return aliases.select("alias", "source", "id").unionByName(new).groupBy("alias", "source").agg(F.min("id").alias("id"))
