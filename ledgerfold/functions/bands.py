"""Banding, category maps and ordered rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

INF = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: Column | str) -> Column:
    """NaN becomes NULL, the engine's only missing value."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def _ladder(col: Column | str, edges: Sequence[float], values: Sequence, closed: str, include_lowest: bool) -> Column:
    """One comparison per edge, in rising order: a row leaves at its interval."""
    if len(values) != len(edges) - 1:
        raise ValueError("need one label fewer than edges")
    if closed not in ("right", "left"):
        raise ValueError("closed must be 'right' or 'left'")
    x, none = _col(col), F.lit(None)
    right = closed == "right"
    below = (lambda e: x <= e) if right else (lambda e: x < e)
    chain = F.when(x.isNull() | F.isnan(x.cast("double")), none)
    if edges[0] != -INF:
        chain = chain.when(x < edges[0] if right and include_lowest else below(edges[0]), none)
    for hi, value in zip(edges[1:], values):
        if hi == INF:
            return chain.otherwise(F.lit(value))
        chain = chain.when(below(hi), F.lit(value))
    return chain.otherwise(none)


def band(
    col: Column | str, edges: Sequence[float], labels: Sequence[str], *,
    closed: str = "right", include_lowest: bool = False,
) -> Column:
    """Label of the interval holding ``col``; NULL outside, for NULL and for NaN.

    >>> df.withColumn("tier", band("fee", [0, 3, 8, 20, INF], ["MICRO", "LOW", "MID", "HIGH"]))
    """
    return _ladder(col, edges, labels, closed, include_lowest)


def band_ordinal(
    col: Column | str, edges: Sequence[float], *, closed: str = "right", include_lowest: bool = False
) -> Column:
    """Interval number 0..k-1, for sorting bands in their natural order."""
    return _ladder(col, edges, list(range(len(edges) - 1)), closed, include_lowest)


def apply_band(col: Column | str, spec: Mapping) -> Column:
    """Band by a preset: ``{"edges", "labels"[, "closed", "include_lowest"]}``."""
    return band(col, spec["edges"], spec["labels"], closed=spec.get("closed", "right"),
                include_lowest=spec.get("include_lowest", False))


def first_rule(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """Label of the first condition that is true, else ``default``."""
    chain = reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])) if acc is not None else F.when(r[0], F.lit(r[1])),
                   rules, None)
    return chain.otherwise(F.lit(default))


def regex_family(col: Column | str, patterns: Sequence[tuple[str, str]], default: str = "Other") -> Column:
    """Family of the first case-insensitive pattern found in ``col``."""
    text = F.coalesce(_col(col), F.lit(""))
    return first_rule([(text.rlike("(?i)" + p), label) for p, label in patterns], default)


def map_label(col: Column | str, mapping: Mapping[str, str], default: str) -> Column:
    """Look a category up in a small fixed map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(col)), F.lit(default))


def tags(rules: Sequence[tuple[str, Column]], sep: str = " | ") -> Column:
    """Join the names of every rule that holds; empty string when none does."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for name, cond in rules])


def rate(pred: Column) -> Column:
    """Share of rows where ``pred`` holds; unknown counts as not holding."""
    return F.avg(F.coalesce(pred, F.lit(False)).cast("double"))
