"""Catalogue of named queries, each with (where SQL can say it) a SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfold.plans import roles
from ledgerfold.session import apply_settings
from ledgerfold.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy readers of one scale-factor folder plus the role views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = apply_settings(spark), sf_dir.rstrip("/")

    def read(self, name: str, where: str | None = None) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet", where=where)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def contests(self) -> DataFrame:
        return roles.contests(self)

    @cached_property
    def entries(self) -> DataFrame:
        return roles.entries(self)

    @cached_property
    def players(self) -> DataFrame:
        return roles.players(self)

    @cached_property
    def snapshots(self) -> DataFrame:
        return roles.snapshots(self)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` as query ``name``.

    ``sql`` is the DuckDB text; it may refer to the role views by name because
    the role CTEs are put in front of it.  A text that starts with a comma goes
    on with further CTEs.
    """

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = roles.PRELUDE + sql.strip()
        return fn

    return deco


def r6(c, digits: int = 6):
    """Round for comparison; also turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)
