"""Event (cluster) bootstrap, false-discovery control, chronological validation.

The fact table is read once and reduced to sums per (group, event).  Everything
after that has at most groups x events rows, whatever the size of the facts.
Draws are hashes of (seed, replicate, position): repeatable under any
partitioning, and shared by all groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerfold import presets as P
from ledgerfold.operators.returns import ratio, unpivot_keys
from ledgerfold.operators import ordered
from ledgerfold.operators.ordered import attach_row


def hash_uniform_int(n: Column, *parts: Column) -> Column:
    """Repeatable integer in [0, n) from the md5 of the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def event_sums(df: DataFrame, by: Sequence[str], event: str, sums: Mapping[str, Column]) -> DataFrame:
    """Per (group, event) sums and row counts: the only shuffle of fact rows."""
    return df.groupBy(*by, event).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(e), F.lit(0.0)).alias(k) for k, e in sums.items()])


def draw_counts(sizes: DataFrame, draws: int, seed: int) -> DataFrame:
    """How often position ``pos`` is drawn in replicate ``b`` among ``n_events``."""
    reps = sizes.select("n_events").distinct().select(
        "n_events", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_rep"))
    shots = reps.select("n_events", "_rep", F.explode(F.sequence(F.lit(0), F.col("n_events").cast("int") - 1)).alias("_j"))
    pos = hash_uniform_int(F.col("n_events"), F.lit(seed), F.col("_rep"), F.col("_j"))
    return shots.select("n_events", "_rep", pos.alias("_pos")).groupBy("n_events", "_rep", "_pos").agg(
        F.count(F.lit(1)).alias("_times"))


@lru_cache(maxsize=4)
def replicate_draws(draws: int, seed: int, n: int) -> np.ndarray:
    """32-bit draws, one row per drawn place and one column per replicate.

    The same numbers as :func:`hash_uniform_int` before its remainder, so one
    table made for the longest calendar serves groups of every size.
    """
    md5, heads = hashlib.md5, [f"{seed}|{b}|" for b in range(draws)]
    return np.array([[int.from_bytes(md5(f"{h}{j}".encode()).digest()[:4], "big") for h in heads] for j in range(n)], dtype=np.uint32).reshape(n, draws)


def replicate_counts(draws: int, seed: int, n: int) -> np.ndarray:
    """How often each of ``n`` positions is drawn: one vector of ``draws`` counts per position."""
    size = 64
    while size < n:
        size *= 2
    place = replicate_draws(draws, seed, size)[:n] % np.uint32(n)
    key = place.astype(np.int64) * draws + np.arange(draws)
    return np.bincount(key.ravel(), minlength=n * draws).reshape(n, draws)


def bootstrap_ratio(
    sums: DataFrame, by: Sequence[str], event: str, num: str, den: str, *, draws: int = P.BOOTSTRAP_DRAWS,
    ci: float = P.CONFIDENCE, seed: int = P.SEED, null_value: float = P.ROI_NULL, with_multiplicity: bool = True,
) -> DataFrame:
    """Interval, spread and two-sided p of ``sum(num)/sum(den)`` over event resamples.

    ``sums`` comes from :func:`event_sums`.  A group is one row per event, so a
    task multiplies its sums with the replicate vectors of its positions; no
    table of draws is shuffled.  ``with_multiplicity=False`` counts a repeatedly
    drawn event once.
    """
    group = by or ["_all"]
    rows = sums.select(*by, *([] if by else [F.lit(1).alias("_all")]), F.col(event).alias("_event"), F.col(num).cast("double").alias("_n"),
                       F.col(den).cast("double").alias("_d"), F.col("n_rows").cast("long").alias("_rows"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in group)
    stats = ["point_estimate", "n_events", "n_samples", "ci_lower", "ci_upper", "std", "p_value"]
    schema = kinds + "".join(f", {c} {'long' if c.startswith('n_') else 'double'}" for c in stats)

    def resample(table):
        table = table.sort_by([("_event", "ascending")])
        # nulls first, as an ascending order has them in Spark
        at = np.argsort(~np.asarray(table["_event"].is_null()), kind="stable")
        n, d = table["_n"].to_numpy()[at], table["_d"].to_numpy()[at]
        counts = replicate_counts(draws, seed, len(at))
        counts = counts if with_multiplicity else np.minimum(counts, 1)
        top, bottom = n @ counts, d @ counts
        x = np.divide(top, bottom, out=np.zeros(draws), where=bottom > 0)
        low, high = np.quantile(x, [(1 - ci) / 2, 1 - (1 - ci) / 2])
        side = (x <= null_value) if x.mean() >= null_value else (x >= null_value)
        whole = float(d.sum())
        values = [float(n.sum()) / whole if whole else None, len(at), int(table["_rows"].to_numpy().sum()), float(low), float(high),
                  float(x.std()), min(1.0, 2 * float(side.mean()))]
        return pa.table({**{g: table[g].slice(0, 1) for g in group},
                         **{c: pa.array([v], pa.int64() if c.startswith("n_") else pa.float64()) for c, v in zip(stats, values)}})

    out = rows.groupBy(*group).applyInArrow(resample, schema)
    return out if by else out.drop("_all")


def roi_interval(
    df: DataFrame, by: Sequence[str], event: str = "date_id", *, payout="payout", cost="cost", weight="user_count", **kw
) -> DataFrame:
    """Event bootstrap of weighted ROI per group."""
    sums = event_sums(df, by, event, {"wp": F.col(payout) * F.col(weight), "wc": F.col(cost) * F.col(weight)})
    return bootstrap_ratio(sums, by, event, "wp", "wc", **kw)


def unpivot_dims(df: DataFrame, dims: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Each row once per (analysis, bucket) it falls into."""
    return unpivot_keys(df, {a: [c] for a, c in dims.items()}, keep).withColumnRenamed("k0", "bucket")


def all_dimension_intervals(
    df: DataFrame, dims: Mapping[str, str], event: str = "date_id", *, q: float = P.FDR_Q, **kw
) -> DataFrame:
    """Intervals, p-values and FDR verdict for every bucket of every dimension."""
    long = unpivot_dims(df, dims, [event, "payout", "cost", "user_count"])
    out = roi_interval(long, ["analysis", "bucket"], event, **kw)
    return benjamini_hochberg(out, "p_value", ["analysis", "bucket"], q=q)


def benjamini_hochberg(df: DataFrame, p: str, tie: Sequence[str], *, q: float = P.FDR_Q) -> DataFrame:
    """Add ``survives_fdr``: p at or below the largest ``p_(k) <= k/n*q``.

    The input is a table of hypotheses (tens of rows), so one window over all
    of it is bounded.
    """
    w = Window.partitionBy(F.lit(1))
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(p, *tie))).withColumn("_n", F.count(p).over(w))
    cut = F.max(F.when(F.col(p) <= F.col("_r") / F.col("_n") * q, F.col("_r"))).over(w)
    return ranked.withColumn("_k", cut).withColumn(
        "survives_fdr", F.coalesce(F.col("_r") <= F.col("_k"), F.lit(False))).drop("_r", "_n", "_k")


def fdr_summary(df: DataFrame, p: str = "p_value", *, q: float = P.FDR_Q) -> DataFrame:
    """Number of tests, survivors and the largest surviving p."""
    return df.agg(
        F.count(p).alias("total_tests"), F.sum(F.col("survives_fdr").cast("long")).alias("surviving"),
        F.sum((~F.col("survives_fdr")).cast("long")).alias("rejected"), F.lit(q).alias("q"), F.min(p).alias("min_p"),
        F.max(F.when(F.col("survives_fdr"), F.col(p))).alias("max_surviving_p"))


def event_ranks(df: DataFrame, event: str) -> DataFrame:
    """Distinct events numbered 1.. in order; as many rows as there are dates."""
    w = Window.partitionBy(F.lit(1)).orderBy(event)
    days = df.where(F.col(event).isNotNull()).select(event).distinct()
    return days.withColumn("event_no", F.row_number().over(w)).withColumn(
        "n_events_total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))


def chronological_split(df: DataFrame, event: str = "date_id", fraction: float = P.TRAIN_FRACTION) -> DataFrame:
    """Add ``period``: the first ``int(n*fraction)`` dates are ``train``."""
    e = event_ranks(df, event)
    period = F.when(F.col("event_no") <= F.floor(F.col("n_events_total") * F.lit(fraction)), "train").otherwise("test")
    return df.join(e.select(event, period.alias("period")), event)


def validate_rules(
    df: DataFrame, rules: Sequence[tuple[str, str]], event: str = "date_id", *,
    min_rows: int = P.MIN_BUCKET_ROWS, **kw,
) -> DataFrame:
    """Check (dimension, bucket) rules in both periods with one bootstrap.

    A rule holds when the lower end beats the null in train and in test; a
    period with fewer than ``min_rows`` rows is insufficient.  Every rule has a
    row in the result, also one without any rows.
    """
    null_value = kw.get("null_value", P.ROI_NULL)
    dims = {d: d for d, _ in rules}
    wanted = F.lit(False)
    for d, b in rules:
        wanted = wanted | ((F.col("analysis") == d) & (F.col("bucket") == b))
    split = chronological_split(df, event)
    long = unpivot_dims(split, dims, [event, "period", "payout", "cost", "user_count"]).where(wanted)
    ci = roi_interval(long, ["analysis", "bucket", "period"], event, **kw)
    enough = F.col("n_samples") >= min_rows
    ci = ci.withColumn("profitable", enough & (F.col("ci_lower") > null_value))
    side = lambda p, c: F.max(F.when(F.col("period") == p, F.when(enough, F.col(c))))
    flag = lambda p: F.coalesce(F.max(F.when(F.col("period") == p, F.col("profitable"))), F.lit(False))
    rows = lambda p: F.coalesce(F.max(F.when(F.col("period") == p, F.col("n_samples"))), F.lit(0))
    named = df.sparkSession.createDataFrame([tuple(r) for r in rules], "analysis string, bucket string").distinct()
    checked = ci.groupBy("analysis", "bucket").agg(
        *[side(p, c).alias(f"{p}_{n}") for p in ("train", "test")
          for c, n in (("point_estimate", "roi"), ("ci_lower", "ci_lower"), ("ci_upper", "ci_upper"))],
        *[F.coalesce(side(p, "p_value"), F.lit(1.0)).alias(f"{p}_p_value") for p in ("train", "test")],
        *[rows(p).alias(f"{p}_n") for p in ("train", "test")],
        (flag("train") & flag("test")).alias("holds"))
    # a rule no row falls under does not hold
    none = {"train_p_value": F.lit(1.0), "test_p_value": F.lit(1.0), "train_n": F.lit(0), "test_n": F.lit(0), "holds": F.lit(False)}
    return named.join(checked, ["analysis", "bucket"], "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})


def poisson_cuts(steps: int = 2 ** 31) -> list[float]:
    """Distribution function of Poisson(1) at 0, 1, ... until the next count is
    out of reach of a uniform with ``steps`` values."""
    from math import exp, factorial
    total, out = 0.0, []
    while total <= 1 - 1 / steps:
        total += exp(-1) / factorial(len(out))
        out.append(total)
    return out


def poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform by inverting the distribution function."""
    cuts = poisson_cuts()
    chain = None
    for k, cut in enumerate(cuts):
        chain = F.when(u < cut, F.lit(k)) if chain is None else chain.when(u < cut, F.lit(k))
    return chain.otherwise(F.lit(len(cuts)))


DRAW_PRIME = 2 ** 31 - 1


def draw_seeds(seed: int, key: Sequence[str]) -> dict[str, Column]:
    """Two 32-bit numbers per row; replicate b draws ``(_s1 + b*_s2) mod p``.

    Rows are independent of one another in each replicate, and a row's draws
    are pairwise independent over the replicates, for one md5 a row.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return {"_s1": part(1), "_s2": part(9)}


def row_bootstrap_rmse(
    df: DataFrame, key: Sequence[str], y: str, yhat: str, *, draws: int = 1000, ci: float = P.CONFIDENCE, seed: int = P.SEED
) -> DataFrame:
    """Row bootstrap of RMSE with Poisson(1) weights from a hash.

    Each row gives one weight per replicate, summed on the map side: the
    shuffle carries partitions x draws rows, not rows x draws.
    """
    err2 = F.pow(F.col(y) - F.col(yhat), 2)
    reps = df.select(err2.alias("_e"), *[c.alias(n) for n, c in draw_seeds(seed, key).items()]).withColumn(
        "_rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = (F.col("_s1") + F.col("_s2") * F.col("_rep")) % DRAW_PRIME / F.lit(float(DRAW_PRIME))
    per = reps.withColumn("_w", poisson_one(u)).groupBy("_rep").agg(
        F.sqrt(ratio(F.sum(F.col("_e") * F.col("_w")), F.sum("_w"))).alias("x"))
    a = (1 - ci) / 2
    q = per.agg(F.percentile("x", F.array(F.lit(a), F.lit(1 - a))).alias("_q"), F.stddev_pop("x").alias("std"))
    point = df.agg(F.sqrt(F.avg(err2)).alias("rmse"), F.count(F.lit(1)).alias("n_rows"))
    return point.transform(attach_row, q.select(F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"), "std"))


def _rank_pieces(draws: int, chunk: int = 1000):
    """Function for ``mapInPandas`` over rows (_x, _y, _s1, _s2) sorted by _x.

    A task emits its first and its last group of equal scores, which may go on
    in other tasks, and one row for all between them.  Weights exist only for
    ``chunk`` rows at a time.
    """
    cuts, reps = np.array(poisson_cuts()), np.arange(draws, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        low, rank, pos, num = None, np.zeros(draws), np.zeros(draws), np.zeros(draws)
        for pdf in batches:
            for at in range(0, len(pdf), chunk):
                part = pdf.iloc[at:at + chunk]
                x, y = part["_x"].to_numpy(), part["_y"].to_numpy()
                u = (part["_s1"].to_numpy()[:, None] + part["_s2"].to_numpy()[:, None] * reps) % DRAW_PRIME / DRAW_PRIME
                w = np.searchsorted(cuts, u, side="right").astype("float64")
                starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                xs, n = x[starts], np.add.reduceat(w, starts, axis=0)
                p = np.add.reduceat(w * y[:, None], starts, axis=0)
                if last is not None:
                    if last[0] == xs[0]:
                        n[0], p[0] = n[0] + last[2], p[0] + last[1]
                    else:
                        xs, n, p = np.r_[last[0], xs], np.vstack([last[2], n]), np.vstack([last[1], p])
                last, xs, n, p = (xs[-1], p[-1].copy(), n[-1].copy()), xs[:-1], n[:-1], p[:-1]
                if first is None and len(xs):
                    first, xs, n, p = (xs[0], p[0].copy(), n[0].copy()), xs[1:], n[1:], p[1:]
                if len(xs):
                    low = xs[0] if low is None else low
                    rank += ((num + np.cumsum(n, axis=0) - n + (n + 1) / 2) * p).sum(axis=0)
                    pos, num = pos + p.sum(axis=0), num + n.sum(axis=0)
        rows = [(g[0], 0, np.zeros(draws), g[1], g[2]) for g in (first, last) if g is not None]
        if low is not None:
            rows.append((low, 1, rank, pos, num))
        yield pd.DataFrame(rows, columns=["_x", "_inner", "_r", "_p", "_n"])

    return run


def row_bootstrap_auc(
    df: DataFrame, key: Sequence[str], label: str, score: str, *, draws: int = 1000, ci: float = P.CONFIDENCE, seed: int = P.SEED
) -> DataFrame:
    """Row bootstrap of the area under the ROC curve with Poisson(1) weights.

    Rows are ordered once by (score, seed), which also spreads a frequent
    score; each task reduces its range to at most three rows of ``draws``
    numbers, so rows x draws never exist outside a task's current chunk.  A
    resample of one class counts 0.5; rows without label or score are left out.
    """
    x = F.col(score).cast("double")
    d = df.where(F.col(label).isNotNull() & x.isNotNull() & ~F.isnan(x)).select(
        x.alias("_x"), F.col(label).cast("double").alias("_y"), *[c.alias(n) for n, c in draw_seeds(seed, key).items()])
    pieces = d.repartitionByRange("_x", "_s1").sortWithinPartitions("_x").mapInPandas(
        _rank_pieces(draws), "_x double, _inner int, _r array<double>, _p array<double>, _n array<double>")
    # tasks x draws rows from here on
    long = pieces.select("_x", "_inner", F.posexplode(F.arrays_zip("_r", "_p", "_n")).alias("_rep", "_v")).groupBy("_rep", "_x", "_inner").agg(
        *[F.sum(f"_v.{c}").alias(c) for c in ("_r", "_p", "_n")])
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_rep").orderBy("_x", "_inner").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    mean_rank = F.when(F.col("_inner") == 1, F.col("_before")).otherwise(F.col("_before") + (F.col("_n") + 1) / 2)
    per = long.withColumn("_before", before).groupBy("_rep").agg(
        F.sum(F.col("_r") + mean_rank * F.col("_p")).alias("_r"), F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    area = ratio(F.col("_r") - F.col("_P") * (F.col("_P") + 1) / 2, F.col("_P") * (F.col("_N") - F.col("_P")))
    a = (1 - ci) / 2
    q = per.select(F.coalesce(area, F.lit(0.5)).alias("x")).agg(
        F.percentile("x", F.array(F.lit(a), F.lit(1 - a))).alias("_q"), F.stddev_pop("x").alias("std"))
    return q.select(F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"), "std")
