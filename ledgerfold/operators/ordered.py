"""Ordered computations that stay distributed when one group is huge.

A window partitioned by a hot key sends the whole group to one task.  Here rows
are *range*-partitioned by (group, order), so a hot group spreads over many
partitions; each partition computes its local running values, and only the
totals of the earlier partitions of the same group are carried in.  A range
partition continues at most one group, so the carry table has at most one row
per partition -- the broadcast below is bounded by the partition count, never
by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerfold.session import materialize

PART = "_part"


def _names(order: Sequence[str]) -> list[str]:
    return [o[1:] if o.startswith("-") else o for o in order]


def sort_columns(order: Sequence[str]) -> list[Column]:
    """``"-x"`` sorts descending, nulls always last."""
    return [
        F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last()
        for o in order
    ]


def range_parts(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by ``by`` then ``order`` and pin the partition number.

    The result is written out: the range bounds are sampled, so re-evaluating
    the exchange for a second consumer could otherwise place rows differently.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(b).asc_nulls_last() for b in by] + sort_columns(order)
    ranged = df.repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id())
    return materialize(ranged, "ranged")


def _same(left: str, right: str, by: Sequence[str]) -> Column:
    cond = F.col(f"{left}.{PART}") == F.col(f"{right}.{PART}")
    for b in by:
        cond = cond & F.col(f"{left}.{b}").eqNullSafe(F.col(f"{right}.{b}"))
    return cond


def with_carry(parts: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the carry columns by (partition, group).

    Only a group that continues from an earlier partition has a carry row, so
    the broadcast table has at most one row per range partition.
    """
    extra = [c for c in carry.columns if c not in {PART, *by}]
    return parts.alias("l").join(F.broadcast(carry.alias("r")), _same("l", "r", by), "left").select(
        "l.*", *[F.col(f"r.{c}") for c in extra])


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    sums: Mapping[str, Column | str] | None = None,
    maxima: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Add running values within ``by`` along ``order`` (current row included).

    ``number`` names a row number column, ``sums`` and ``maxima`` map new
    column names to the expression accumulated.  ``order`` must be total for a
    repeatable row number.
    """
    sums = {k: (F.col(v) if isinstance(v, str) else v) for k, v in (sums or {}).items()}
    maxima = {k: (F.col(v) if isinstance(v, str) else v) for k, v in (maxima or {}).items()}
    source = df
    for name, expr in {**sums, **maxima}.items():
        source = source.withColumn(f"_in_{name}", expr)
    parts = range_parts(source, by, order)

    local = Window.partitionBy(PART, *by).orderBy(*sort_columns(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = parts
    if number:
        out = out.withColumn(number, F.row_number().over(
            Window.partitionBy(PART, *by).orderBy(*sort_columns(order))).cast("long"))
    for name in sums:
        out = out.withColumn(name, F.sum(f"_in_{name}").over(local))
    for name in maxima:
        out = out.withColumn(name, F.max(f"_in_{name}").over(local))

    totals = parts.groupBy(PART, *by).agg(
        F.count(F.lit(1)).alias("_c_rows"),
        *[F.sum(f"_in_{n}").alias(f"_c_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_c_{n}") for n in maxima],
    )
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        PART, *by,
        F.sum("_c_rows").over(before).alias("_c_rows"),
        *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(before).alias(f"_c_{n}") for n in maxima],
    ).where(F.col("_c_rows").isNotNull())

    joined = with_carry(out, carry, by)
    made = {}
    if number:
        made[number] = F.col(number) + F.coalesce(F.col("_c_rows"), F.lit(0))
    for name in sums:
        made[name] = F.when(F.col(name).isNotNull() | F.col(f"_c_{name}").isNotNull(),
                            F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
    for name in maxima:
        made[name] = F.greatest(F.col(name), F.col(f"_c_{name}"))
    kept = [c for c in df.columns if c not in made]
    return joined.select(*kept, *[v.alias(k) for k, v in made.items()])


def value_positions(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """One row per distinct (by, value): ``_n`` copies ending at position ``_cum``.

    Pre-aggregation collapses ties first, so a value held by a third of all
    rows is one row before anything is ordered.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    return running(counts, by, [col], number="_dense", sums={"_cum": "_n"})


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row.

    A scalar subquery, not a join: Spark runs it once, ships one value, and
    fails if it ever holds a second row.
    """
    row = one.select(F.struct(*one.columns).alias("_s")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[c].alias(c) for c in one.columns])


def _join_by(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Null-safe N:1 join on ``by`` keeping the left key columns."""
    if not by:
        return attach_row(left, right)
    cond = None
    for b in by:
        part = F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
        cond = part if cond is None else cond & part
    extra = [c for c in right.columns if c not in by]
    return left.alias("l").join(right.alias("r"), cond, how).select(
        "l.*", *[F.col(f"r.{c}") for c in extra])


def percentiles(
    df: DataFrame, by: Sequence[str], col: str, points: Mapping[str, float]
) -> DataFrame:
    """Exact, linearly interpolated percentiles per group.

    Same values as ``percentile(col, q)`` but without holding a group's value
    map in one task: positions come from distributed running counts.
    """
    pos = value_positions(df, by, col)
    size = pos.groupBy(*by).agg(F.sum("_n").alias("_size"))
    placed = _join_by(pos, size, by, "inner")
    first, last = F.col("_cum") - F.col("_n"), F.col("_cum")
    aggs, outs = [], []
    for name, q in points.items():
        at = F.lit(float(q)) * (F.col("_size") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((first <= lo) & (lo < last), F.col(col))).cast("double").alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi < last), F.col(col))).cast("double").alias(f"_hi_{name}"),
        ]
        frac = at - lo
        outs.append((F.col(f"_lo_{name}") + frac * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return placed.groupBy(*by).agg(F.max("_size").alias("_size"), *aggs).select(*by, *outs)


def with_percentiles(
    df: DataFrame, by: Sequence[str], col: str, points: Mapping[str, float]
) -> DataFrame:
    """Attach :func:`percentiles` of the group to each of its rows."""
    return _join_by(df, percentiles(df, by, col, points), by, "left")


def ranks(
    df: DataFrame, by: Sequence[str], col: str, *, name: str, method: str = "min",
    descending: bool = False,
) -> DataFrame:
    """Rank ``col`` within ``by``: ``min``, ``max``, ``average``, ``dense`` or ``pct``.

    ``pct`` is the average rank over the number of non-null values.  Rows with a
    null value keep a null rank.
    """
    if method == "first":
        raise ValueError("method 'first' needs a total order: use running(number=...)")
    key = "_rankkey"
    src = df.withColumn(key, -F.col(col) if descending else F.col(col))
    pos = value_positions(src, by, key)
    if method == "pct":
        size = pos.groupBy(*by).agg(F.sum("_n").alias("_size"))
        pos = _join_by(pos, size, by, "inner")
    avg = F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)
    value = {
        "min": lambda: F.col("_cum") - F.col("_n") + 1,
        "max": lambda: F.col("_cum"),
        "dense": lambda: F.col("_dense"),
        "average": lambda: avg,
        "pct": lambda: avg / F.col("_size"),
    }[method]()
    table = pos.select(*by, key, value.alias(name))
    return _join_by(src, table, [*by, key], "left").drop(key)
