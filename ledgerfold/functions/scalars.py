"""Scalar functions as column expressions: names, odds, dates, maths, sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names ----------------------------------------------------------------

def normalize_name(name: Column | str) -> Column:
    """Lower case, no periods, hyphens as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(_col(name)), "-.", " "), r"\s+", " "))


def last_name(norm: Column | str) -> Column:
    """Last token of a normalised name."""
    return F.element_at(F.split(_col(norm), " "), -1)


def reversed_name(norm: Column | str) -> Column:
    """``"b a"`` for ``"a b"``; NULL unless there are exactly two tokens."""
    t = F.split(_col(norm), " ")
    return F.when(F.size(t) == 2, F.concat_ws(" ", F.element_at(t, 2), F.element_at(t, 1)))


# --- odds and stakes ------------------------------------------------------

def american_to_prob(odds: Column | str) -> Column:
    """Implied probability of American odds; even for 0, NULL for NULL."""
    o = _col(odds).cast("double")
    return F.when(o > 0, F.lit(100.0) / (o + 100)).when(o < 0, -o / (100 - o)).when(o == 0, F.lit(0.5))


def break_even(odds: Column | str) -> Column:
    """Win rate at which a bet at these odds returns its stake."""
    return american_to_prob(odds)


def edge(prob: Column | str, odds: Column | str) -> Column:
    """Win probability minus the break-even rate."""
    return _col(prob) - break_even(odds)


def kelly(prob: Column | str, odds: Column | str, fraction: float = 1.0) -> Column:
    """Fractional Kelly stake, never negative; zero at odds of zero."""
    p, o = _col(prob), _col(odds).cast("double")
    b = F.when(o > 0, o / 100).when(o < 0, F.lit(100.0) / -o)
    return F.when(b.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (b * p - (1 - p)) / b) * fraction)


# --- dates ----------------------------------------------------------------

def date_from_id(date_id: Column | str) -> Column:
    """Date of an integer ``yyyyMMdd``; NULL when it is not a date."""
    return F.try_to_timestamp(_col(date_id).cast("string"), F.lit("yyyyMMdd")).cast("date")


def date_id(ts: Column | str) -> Column:
    """Integer ``yyyyMMdd`` of a timestamp or date."""
    return F.date_format(_col(ts), "yyyyMMdd").cast("int")


def closing_instant(date_id_col: Column | str, hours: int = 26) -> Column:
    """Instant at which prices of that date are final."""
    return date_from_id(date_id_col).cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))


def local_date_id(commence: Column | str, shift_hours: int = 6) -> Column:
    """Local event date of an ISO-8601 UTC start time; NULL if unparsable."""
    ts = F.try_to_timestamp(_col(commence)) - F.make_dt_interval(hours=F.lit(shift_hours))
    return date_id(ts)


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """Monday-based weekday, month, ISO week, weekend flag, day, quarter."""
    d = _col(ts)
    return {"dow": F.weekday(d), "month": F.month(d), "week": F.weekofyear(d),
            "is_weekend": (F.weekday(d) >= 5).cast("int"), "day": F.dayofmonth(d), "quarter": F.quarter(d)}


def cyclic(x: Column | str, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value."""
    from math import pi
    angle = _col(x) * (2 * pi / period)
    return F.sin(angle), F.cos(angle)


# --- numeric --------------------------------------------------------------

def clip(x: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp; NULL stays NULL."""
    c = v = _col(x)
    if lo is not None:
        v = F.greatest(v, F.lit(lo))
    if hi is not None:
        v = F.least(v, F.lit(hi))
    return F.when(c.isNotNull(), v)


def log_shift(x: Column | str, offset: float = 1.0) -> Column:
    """``log(max(x, 0) + offset)``."""
    return F.log1p(clip(x, 0.0) + F.lit(offset - 1.0))


def signed_power(x: Column | str, power: float) -> Column:
    """``sign(x) * |x|**power``; square root clips below zero instead."""
    c = _col(x)
    if power == 0.5:
        return F.sqrt(clip(c, 0.0))
    return F.pow(c, F.lit(2.0)) if power == 2 else F.signum(c) * F.pow(F.abs(c), F.lit(float(power)))


def safe_ratio(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """``a / (b + eps)``."""
    return F.try_divide(_col(a), _col(b) + F.lit(eps))


# --- normal distribution --------------------------------------------------

# Acklam's rational approximation of the inverse normal, with
# the break points, in its published order.
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
      -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
      -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
      4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
_LOW = 0.02425
# Abramowitz and Stegun 26.2.17.
_AS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _poly(coefs: Sequence[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_ppf(p: Column | str) -> Column:
    """Inverse normal distribution function (relative error below 1.2e-9)."""
    p = _col(p)
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    r = q * q
    mid = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    tail = lambda s: _poly(_C, s) / (_poly(_D, s) * s + 1)
    return F.when((p > 0) & (p < _LOW), tail(low)).when((p >= _LOW) & (p <= 1 - _LOW), mid).when(
        (p > 1 - _LOW) & (p < 1), -tail(high))


def normal_cdf(x: Column | str) -> Column:
    """Normal distribution function (absolute error below 7.5e-8)."""
    from math import pi, sqrt
    x = _col(x)
    z = F.abs(x)
    k = F.lit(1.0) / (1 + 0.2316419 * z)
    upper = F.exp(-z * z / 2) / sqrt(2 * pi) * _poly(tuple(reversed(_AS)), k) * k
    return F.when(x >= 0, 1 - upper).when(x < 0, upper)


# --- delimited sets -------------------------------------------------------

def members(set_key: Column | str, sep: str = ":") -> Column:
    """Members of a delimited set as an integer array."""
    return F.split(_col(set_key), sep).cast("array<bigint>")


def n_missing(set_key: Column | str, sep: str = ":", hole: int = -1) -> Column:
    """Number of unknown slots."""
    return F.size(F.filter(members(set_key, sep), lambda x: x == hole))


def fill_holes(arr: Column | str, fills: Column, hole: int = -1) -> Column:
    """Replace the k-th unknown slot by ``fills[k]``."""
    a = _col(arr)
    nth = lambda i: F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y == hole))
    return F.transform(a, lambda x, i: F.when(x == hole, F.try_element_at(fills, nth(i))).otherwise(x))


def params_hash(struct: Column) -> Column:
    """Eight hex digits that identify a parameter set."""
    return F.substring(F.md5(F.to_json(struct)), 1, 8)
