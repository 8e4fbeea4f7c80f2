"""Reading, profiling and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ledgerfold.session import scratch_dir


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """Return ``df`` or raise :class:`MissingColumns`."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(f"{what} lacks columns: {', '.join(lacking)}")
    return df


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet", *, where: str | None = None, **options,
) -> DataFrame:
    """Read a table; floating columns lose their NaN in favour of NULL.

    ``where`` is a conjunction of comparisons of columns with constants.  It is
    applied to the file's own columns, so the scan can prune by it, and again
    after the replacement: a comparison holds for no NULL, so the first filter
    keeps all rows that the second one keeps.
    """
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return nan_to_null(df) if where is None else nan_to_null(df.where(where)).where(where)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


def well_scraped(contests: DataFrame, entries: DataFrame, members: DataFrame, *, tolerance: float, only: bool = True) -> DataFrame:
    """Contests with paid-out total, fight count and a completeness flag.

    Facts are aggregated per contest before the join.  ``only`` keeps contests
    whose payouts match the advertised pool within the tolerance.
    """
    paid = entries.groupBy("contest_id").agg(F.sum(F.col("payout") * F.col("user_count")).alias("scraped_prizes"))
    fights = members.groupBy("contest_id").agg(F.expr("count(DISTINCT player_id) div 2").alias("n_fights"))
    c = contests.join(paid, "contest_id", "left").join(fights, "contest_id", "left")
    c = c.withColumn("scraped_prizes", F.coalesce("scraped_prizes", F.lit(0.0)))
    c = c.withColumn("payout_ratio", F.when(F.col("total_prizes") > 0, F.try_divide("scraped_prizes", "total_prizes")))
    c = c.withColumn("is_well_scraped", F.coalesce(F.col("payout_ratio").between(1 - tolerance, 1 + tolerance), F.lit(False)))
    return c.where("is_well_scraped") if only else c


def profile_tables(tables: Mapping[str, DataFrame], dates: Mapping[str, str]) -> DataFrame:
    """Row count and (where a date column is named) first, last and distinct dates."""
    out = None
    for name, df in tables.items():
        d = F.col(dates[name]) if name in dates else F.lit(None)
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                     F.min(d).cast("string").alias("first"), F.max(d).cast("string").alias("last"), F.countDistinct(d).alias("n_dates"))
        out = row if out is None else out.unionByName(row)
    return out


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Order-independent content hash, row count and schema hash of a table."""
    cols = sorted(df.columns)
    return df.agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"),
    ).withColumn("schema_hash", F.md5(F.lit(";".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields))))


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def latest(incoming: DataFrame, keys: Sequence[str], batch: str | None = None) -> DataFrame:
    """One row per key: the one of the largest ``batch``; without it, or among
    equal batches, the row whose values are largest, so a rerun agrees."""
    rest = [c for c in incoming.columns if c not in {*keys, batch}]
    order = F.struct(*([batch] if batch else []), *rest)
    one = incoming.groupBy(*keys).agg(F.max(order).alias("_row"))
    return one.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in incoming.columns])


def merge_rows(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: rows of ``incoming``, unique per key, replace rows with the same key."""
    rest = current.join(incoming.select(*keys), list(keys), "left_anti")
    return rest.unionByName(incoming, allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition: str, batch: str | None = None) -> None:
    """Upsert into a partitioned table, rewriting only the partitions touched.

    Of several incoming rows with one key the latest ``batch`` wins.  Touched
    are the partitions of the incoming rows and those that hold their keys now,
    so a key may move.  Keys and partition values are not null.  The result is
    staged first because a table cannot be overwritten while it is read; a
    partition whose last row moved away is removed after that.  Running it
    again after a failure gives the same table.
    """
    current = spark.read.parquet(path)
    new = latest(incoming, keys, batch)
    moved = current.join(new.select(*keys), list(keys), "left_semi").select(partition)
    touched = current.join(moved.unionByName(new.select(partition)).distinct(), partition, "left_semi")
    stage = f"{scratch_dir(spark)}/upsert-{uuid.uuid4().hex}"
    merge_rows(touched, new, keys).select(*current.columns).write.parquet(stage)
    merged = spark.read.schema(current.schema).parquet(stage)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    held = current.select(partition, folder.alias("_folder")).join(moved.distinct(), partition, "left_semi")
    emptied = held.join(merged.select(partition).distinct(), partition, "left_anti").select("_folder").distinct()
    folders = [r["_folder"] for r in emptied.collect()]  # at most one per partition
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for name in folders:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_json(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Report rows as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def result_row(spark: SparkSession, run: str, model: str, metrics: DataFrame, config: Mapping) -> DataFrame:
    """One evaluation-result row: metrics and the configuration as JSON."""
    import json
    return metrics.select(F.lit(run).alias("run_id"), F.lit(model).alias("model"),
                          F.to_json(F.struct(*metrics.columns)).alias("metrics"),
                          F.lit(json.dumps(dict(config), sort_keys=True)).alias("config"))


def append_results(df: DataFrame, path: str) -> None:
    """Append rows to the evaluation-result table."""
    df.write.mode("append").parquet(path)


def seed_dimension(spark: SparkSession, names: Sequence[str], key: str = "source_id", name: str = "source_name") -> DataFrame:
    """Small fixed dimension with ids in the order given, names unique."""
    seen = list(dict.fromkeys(names))
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(seen)], f"{key} int, {name} string")
