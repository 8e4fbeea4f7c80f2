"""Characteristic polynomials and eigenvectors of integer symmetric matrices.

The polynomial is found modulo word-sized primes (Hessenberg reduction, one
prime per row of a Spark frame) and put together by Chinese remainders.  All
roots are real, so Descartes' rule counts the roots above a point exactly, with
multiplicity; roots are isolated by bisection in integers and refined as far as
asked.  Components are null vectors of ``matrix - root``, found by inverse
iteration in integer arithmetic.  Nothing here grows with the number of rows:
the work depends on the dimension and the bits of the matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

TOP_PRIME = (1 << 31) - 1
GUARD_BITS = 128


def _is_prime(n: int) -> bool:
    """Miller-Rabin; the bases decide every number below 2**32."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2**31, downwards, whose product has more than ``bits`` bits, and one more."""
    out, n, have = [], TOP_PRIME, 0
    while have <= bits:
        if _is_prime(n):
            out.append(n)
            have += n.bit_length() - 1
        n -= 2
    while not _is_prime(n):
        n -= 2
    return [*out, n]


def hessenberg(h: np.ndarray, p: int) -> np.ndarray:
    """Similar upper Hessenberg matrix modulo ``p`` (in place)."""
    d = len(h)
    for m in range(1, d - 1):
        live = np.flatnonzero(h[m:, m - 1])
        if not len(live):
            continue
        if at := int(live[0]):
            h[[m, m + at]] = h[[m + at, m]]
            h[:, [m, m + at]] = h[:, [m + at, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(1)) % p
    return h


def modular_polynomial(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of ``det(xI - matrix)`` modulo ``p``."""
    d = len(matrix)
    h = hessenberg(matrix.copy(), p)
    out = np.zeros((d + 1, d + 1), dtype=np.int64)
    out[0, 0] = 1
    for k in range(d):
        out[k + 1, 1:] = out[k, :-1]
        weight = np.empty(k + 1, dtype=np.int64)  # of the polynomials 0..k
        below = 1
        for i in range(k, -1, -1):
            weight[i] = int(h[i, k]) * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        out[k + 1] = (out[k + 1] - (weight[:, None] * out[:k + 1] % p).sum(0)) % p
    return out[d]


def chinese(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """The smallest integers, by absolute value, with these residues."""
    value, m = [0] * len(residues[0]), 1
    for row, p in zip(residues, moduli):
        inverse = pow(m, -1, p)
        value = [v + m * ((r - v) * inverse % p) for v, r in zip(value, row)]
        m *= p
    return [v - m if 2 * v > m else v for v in value]


def coefficient_bits(matrix: list[list[int]]) -> int:
    """Bits that hold every coefficient of a positive semidefinite matrix.

    The k-th is at most ``C(d, k) * (trace / d) ** k`` (Maclaurin).
    """
    d = len(matrix)
    mean = max(1, -(-sum(matrix[i][i] for i in range(d)) // d))
    return max((math.comb(d, k) * mean ** k).bit_length() for k in range(d + 1)) + 2


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, constant first; one prime per row of a Spark frame.

    The last prime takes no part in the remaindering and checks the result.
    """
    moduli = primes(coefficient_bits(matrix))
    shared = spark.sparkContext.broadcast(matrix)  # d x d integers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(shared.value, dtype=object)
        for batch in batches:
            at = batch.column(0).to_pylist()
            rows = [modular_polynomial((exact % moduli[k]).astype(np.int64), moduli[k]) for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["k", "c"])

    tasks = min(len(moduli), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(moduli), 1, tasks).mapInArrow(work, "k long, c array<long>").collect()
    found = [list(r["c"]) for r in sorted(rows, key=lambda r: r["k"])]
    out = chinese(found[:-1], moduli[:-1])
    if [c % moduli[-1] for c in out] != found[-1]:
        raise ArithmeticError("the remainders do not fit one polynomial")
    return out


# --- roots ---------------------------------------------------------------------

def _mod_gcd(a: list[int], b: list[int], p: int) -> list[int]:
    """Monic greatest common divisor modulo ``p``."""
    def trimmed(x):
        live = np.flatnonzero(x)
        return x[:live[-1] + 1] if len(live) else x[:0]

    x, y = (trimmed(np.array([c % p for c in v], dtype=np.int64)) for v in (a, b))
    while len(y):
        y = y * pow(int(y[-1]), -1, p) % p
        while len(x) >= len(y):
            x = x.copy()
            x[len(x) - len(y):] = (x[len(x) - len(y):] - int(x[-1]) * y % p) % p
            x = trimmed(x)
        x, y = y, x
    return [int(c) for c in x]


def _divided(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder of integer polynomials; ``b`` is monic."""
    rest, out = list(a), [0] * (len(a) - len(b) + 1)
    for k in range(len(out) - 1, -1, -1):
        out[k] = q = rest[k + len(b) - 1]
        for j, c in enumerate(b):
            rest[k + j] -= q * c
    return out, rest[:len(b) - 1]


def square_free(poly: list[int]) -> list[int]:
    """The monic polynomial with the same roots, each of them once.

    A divisor of degree 0 modulo one prime proves that ``poly`` has no repeated
    root.  Otherwise the divisor is put together from its remainders (those of
    the least degree) and proved by division.
    """
    slope = [k * c for k, c in enumerate(poly)][1:]
    bits = max(abs(c).bit_length() for c in poly) + 2
    kept, degree = [], len(poly)
    for p in primes(3 * bits + 128):
        g = _mod_gcd(poly, slope, p)
        if len(g) == 1:
            return poly
        if len(g) < degree:
            kept, degree = [], len(g)
        if len(g) == degree:
            kept.append((g, p))
            if math.prod(x for _, x in kept).bit_length() > bits + 31:
                common = chinese([x for x, _ in kept], [x for _, x in kept])
                whole, rest = _divided(poly, common)
                if not any(rest) and not any(_divided(slope, common)[1]):
                    return whole
                kept = kept[-1:]
    raise ArithmeticError("no common divisor fits its remainders")


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are ``2**bits`` times as large."""
    d = len(poly) - 1
    return [c << (bits * (d - k)) for k, c in enumerate(poly)]


def roots_above(poly: list[int], a: int) -> int:
    """Number of roots above ``a``, with multiplicity: sign changes of ``poly(x + a)``.

    Descartes' rule is exact where all roots are real.
    """
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(poly: list[int], a: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * a + c
    return total


class Root:
    """An isolated root: ``low < root * 2**bits <= high``, and its multiplicity."""

    def __init__(self, low: int, high: int, times: int):
        self.low, self.high, self.times = low, high, times


def top_roots(poly: list[int], count: int) -> tuple[list[Root], int, list[int]]:
    """Positive roots from the largest down until ``count`` are reached with multiplicity
    (and one more, for the gap), the bits of their scale and the square-free polynomial."""
    zeros = next(k for k, c in enumerate(poly) if c)
    core = poly[zeros:]
    if len(core) == 1:
        return [], 0, core
    single = square_free(core)
    bound = -core[-2] + 1  # above the sum of the roots
    bits = max(0, 64 - bound.bit_length() // 2)
    while True:
        whole, once, found, have = scaled(core, bits), scaled(single, bits), [], 0
        todo, narrow = [(0, bound << bits, len(once) - 1, 0)], True
        while todo and have <= count:
            low, high, n_low, n_high = todo.pop()
            if n_low == n_high:
                continue
            if n_low - n_high == 1:
                times = roots_above(whole, low) - roots_above(whole, high)
                found.append(Root(low, high, times))
                have += times
                continue
            if high - low == 1:  # two roots in one unit: a finer scale
                narrow = False
                break
            mid = (low + high) // 2
            n_mid = roots_above(once, mid)
            todo += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
        if narrow:
            return found, bits, single
        bits = 2 * bits + 64


def refined(single: list[int], root: Root, bits: int, wanted: int) -> int:
    """Least integer not below the root times ``2**wanted``."""
    more = wanted - bits
    q = scaled(single, wanted)
    low, high = root.low << more, root.high << more
    at_high = _value(q, high)
    if at_high == 0:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        v = _value(q, mid)
        if v == 0:
            return mid
        if (v > 0) == (at_high > 0):
            high = mid
        else:
            low = mid
    return high


# --- components ----------------------------------------------------------------

def null_vectors(matrix: list[list[int]], root: int, bits: int, times: int, seed: int) -> np.ndarray:
    """``times`` orthonormal vectors with ``matrix @ v = root / 2**bits * v``.

    Two steps of inverse iteration on integers; the triangular factors are
    found once, with row exchanges, and carry ``bits`` fractional bits.
    """
    d = len(matrix)
    a = np.array([[v << bits for v in row] for row in matrix], dtype=object)
    a[range(d), range(d)] -= root
    size = max(1, max(abs(int(v)) for v in a.ravel())).bit_length()
    shift = size + GUARD_BITS
    order = list(range(d))
    factors = np.zeros((d, d), dtype=object)
    for k in range(d):
        at = max(range(k, d), key=lambda i: abs(a[i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
            factors[[k, at]] = factors[[at, k]]
            order[k], order[at] = order[at], order[k]
        if not a[k, k]:
            a[k, k] = 1  # one unit of the last place
        if k + 1 < d:
            f = (a[k + 1:, k] << shift) // a[k, k]
            factors[k + 1:, k] = f
            a[k + 1:, k] = 0
            a[k + 1:, k + 1:] -= (f[:, None] * a[k, k + 1:]) >> shift

    def solve(b):
        y = np.array([b[i] for i in order], dtype=object)
        for k in range(d - 1):
            y[k + 1:] -= (factors[k + 1:, k] * y[k]) >> shift
        z = np.zeros(d, dtype=object)
        for k in range(d - 1, -1, -1):
            rest = y[k] - ((a[k, k + 1:] * z[k + 1:]).sum() >> shift if k + 1 < d else 0)
            z[k] = (rest << shift) // a[k, k]
        return z

    rng = np.random.default_rng(seed)
    out = np.empty((times, d))
    for t in range(times):
        z = np.array([int(v) << shift for v in rng.integers(-1 << 20, 1 << 20, d) * 2 + 1], dtype=object)
        for _ in range(2):
            z = solve(z)
            length = max(1, math.isqrt(int((z * z).sum())))
            z = (z << shift) // length
        out[t] = [float(int(v) >> (shift - 80)) / 2.0 ** 80 for v in z]
    if times > 1:
        for _ in range(2):
            out = np.linalg.qr(out.T)[0].T
    out /= np.sqrt((out * out).sum(1))[:, None]
    lead = np.abs(out).argmax(1)
    return out * np.sign(out[np.arange(times), lead])[:, None]


def top_components(spark: SparkSession, matrix: list[list[int]], count: int) -> tuple[list[float], list[float], np.ndarray]:
    """Roots, their shares of the trace, and unit components, at most ``count``, largest first.

    Roots that are zero have no component here.
    """
    d = len(matrix)
    found, bits, single = top_roots(characteristic_polynomial(spark, matrix), count)
    if not found:
        return [], [], np.empty((0, d))
    gaps = [x.low - y.high for x, y in zip(found, found[1:])]
    gap = max(1, min(gaps, default=1))
    wanted = max(bits + GUARD_BITS, bits - gap.bit_length() + 2 * GUARD_BITS)
    used, have = [], 0
    for r in found:
        if have < count:
            used.append((refined(single, r, bits, wanted), r.times))
            have += r.times
    shared = spark.sparkContext.broadcast((matrix, used))  # d x d integers and at most ``count`` roots

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, roots = shared.value
        for batch in batches:
            at = batch.column(0).to_pylist()
            rows = [null_vectors(exact, roots[k][0], wanted, roots[k][1], k).ravel().tolist() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["k", "v"])

    rows = spark.range(0, len(used), 1, len(used)).mapInArrow(work, "k long, v array<double>").collect()
    parts = [np.array(r["v"]).reshape(-1, d) for r in sorted(rows, key=lambda r: r["k"])]
    trace = sum(matrix[i][i] for i in range(d)) << wanted
    values = [v for v, times in used for _ in range(times)][:count]
    return [float(v / (1 << wanted)) for v in values], [v / trace for v in values], np.concatenate(parts)[:count]
