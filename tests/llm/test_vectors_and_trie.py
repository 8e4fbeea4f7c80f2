"""Whitening, exact top-k search and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import charpoly, queries, trie, vafile, whiten

VECTORS = "vec_id long, embedding array<double>, label int, y string, n long, dim string, node string"


def frame(spark, rows):
    """Vectors with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, 1, "y", 7, "d", "x") for i, v in rows], VECTORS)


# --- characteristic polynomial --------------------------------------------------

def by_traces(m):
    """Faddeev-LeVerrier in fractions: coefficients, constant first."""
    d = len(m)
    a = [[Fraction(x) for x in row] for row in m]
    c, b = [Fraction(1)], [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        p = [[sum(a[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(p[i][i] for i in range(d)) / k)
        b = [[p[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(x) for x in reversed(c)]


def scatter(rng, d, rank, size):
    x = rng.integers(-size, size, (rank, d)).astype(object)
    return [[int(v) for v in row] for row in x.T @ x]


@pytest.mark.parametrize("d,rank,size", [(1, 3, 5), (2, 1, 9), (5, 9, 50), (7, 4, 1000), (6, 20, 10**6), (9, 30, 10**9)])
def test_polynomial_is_exact(spark, d, rank, size):
    m = scatter(np.random.default_rng(d), d, rank, size)
    assert charpoly.characteristic_polynomial(spark, m) == by_traces(m)


def test_repeated_and_zero_roots():
    poly = [1]
    for r in (0, 0, 3, 3, 3, 7, 11, 11):
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert [charpoly.roots_above(poly, a) for a in (-1, 0, 3, 6, 7, 11)] == [8, 6, 3, 3, 2, 0]
    found, bits, single = charpoly.top_roots(poly, 6)
    assert [(charpoly.refined(single, r, bits, bits + 64) >> bits + 64, r.times) for r in found] == [(11, 2), (7, 1), (3, 3)]


def test_close_roots_are_told_apart():
    # (x^2 - 2 * 10^9 x + 10^18 - 1) has the roots 10^9 - 1 and 10^9 + 1; x^2 - 2ax + a^2 - 2 is irrational
    a = 10**12
    found, bits, single = charpoly.top_roots([a * a - 2, -2 * a, 1], 2)
    got = [charpoly.refined(single, r, bits, bits + 200) / 2 ** (bits + 200) - a for r in found]
    assert [r.times for r in found] == [1, 1] and np.allclose(got, [2 ** 0.5, -(2 ** 0.5)], atol=1e-4)


def test_components_of_repeated_values(spark):
    m = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2]]
    values, shares, v = charpoly.top_components(spark, m, 4)
    assert np.allclose(values, [5, 5, 3, 1]) and np.allclose(sum(shares), 1)
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-14) and np.allclose(np.array(m) @ v.T, v.T * values, atol=1e-13)


# --- whitening ------------------------------------------------------------------

def expected_whitening(vectors, k=16):
    x = np.array([[int(np.floor(64 * c)) for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, q = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    values, q = values[order], q[:, order]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.3, (150, 6)) * [3, 1, 2, 0.5, 1, 1]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(100)] + [(3, base[3].tolist())]
    bad = [(2000, None), (2001, [None] * 6), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] * 6), (2004, []), (None, base[1].tolist())]
    df = frame(spark, rows + bad).repartition(5)
    got = whiten.transform(df, whiten.fit(df)).collect()
    usable = [v for _, v in rows] + [bad[-1][1]]
    n, deviation, w, shares = expected_whitening(usable)
    assert len(got) == len(usable) * 6 and {r.n for r in got} == {n}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation.tolist())
    assert got[0].identity_error < 1e-10 and len({r.identity_error for r in got}) == 1
    for k in range(6):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        here = np.array([mine[i].whitened for i, _ in rows])
        sign = np.sign(here @ w[:len(rows), k])
        assert np.allclose(here * sign, w[:len(rows), k], atol=1e-9) and abs(mine[0].explained - shares[k]) < 1e-9
    assert any(r.vec_id is None for r in got)


def test_whitening_of_degenerate_lists(spark):
    assert whiten.fit(frame(spark, [])) == {}
    assert whiten.transform(frame(spark, []), {}).count() == 0
    same = frame(spark, [(i, [0.5, 0.25]) for i in range(9)])
    assert whiten.transform(same, whiten.fit(same)).count() == 0
    # one direction only, two lengths
    line = frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)] + [(9, [1.0]), (10, [4.0])])
    got = whiten.transform(line, whiten.fit(line)).collect()
    assert {(r.vec_id, r.component, r.n) for r in got} == {(i, 1, 5) for i in range(5)} | {(9, 1, 2), (10, 1, 2)}
    assert all(abs(r.explained - 1) < 1e-12 for r in got)


def test_whitening_of_huge_entries(spark):
    rows = [(0, [1e17, 1.0]), (1, [-1e17, 2.0]), (2, [1e30, 5.0])]
    df = frame(spark, rows)
    model = whiten.fit(df)[2]
    clip = lambda v: max(-whiten.LIMIT, min(whiten.LIMIT, int(np.floor(64 * v))))
    x = [[clip(c) for c in v] for _, v in rows]
    assert model.sums == [sum(c) for c in zip(*x)]
    got = whiten.transform(df, {2: model}).where("component = 1").collect()
    assert {r.deviation for r in got} == {None} and model.identity_error < 1e-6


def test_whitening_on_the_table(spark, sf_dir="/root/testdata/sf0.001"):
    got = queries.QUERIES["op11_charpoly_whitening"](spark, sf_dir).toPandas()
    vectors = queries.table(spark, sf_dir, "embeddings").toPandas()
    n, deviation, w, shares = expected_whitening(vectors["embedding"].tolist())
    assert len(got) == 16 * len(vectors)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[vectors["vec_id"]].to_numpy()
    assert np.allclose(np.abs((wide * w).sum(0) / (w * w).sum(0)), 1, atol=1e-9)
    first = got[got["component"] == 1].set_index("vec_id").loc[vectors["vec_id"]]
    assert (first["deviation"].to_numpy() == deviation).all() and np.allclose(first["explained"], shares[0], rtol=1e-9)


# --- exact top-k ------------------------------------------------------------------

def expected_top(rows, k=5, scale=256, every=50):
    live = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(live):
        if i is None or i % every:
            continue
        found = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(live) if a != b and len(v) == len(q)]
        out += [(i, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def top(spark, rows, **kw):
    df = frame(spark, rows).repartition(4)
    return sorted((tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 50 == 0, **kw).collect()), key=str)


def test_top_k_edge_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.4, (180, 5)))]
    rows += [(200 + i, rows[7][1]) for i in range(120)]               # a large group of copies
    rows += [(1000 + i, [0.01, 0.0, 0.0, 0.0, i / 1e6]) for i in range(60)]  # one cell
    rows += [rows[50], rows[50], (50, [0.3] * 5), (None, rows[100][1]), (None, [9.0] * 5)]
    rows += [(5000, None), (5050, [None] * 5), (5100, [float("nan")] * 5), (5150, [float("-inf")] * 5), (5200, []), (5201, []), (5250, [1.0, 2.0])]
    want = expected_top(rows)
    assert top(spark, rows) == want
    assert top(spark, rows, sample=64, block_bytes=200) == want  # coarse cells, many blocks of queries


def test_top_k_of_few_and_none(spark):
    assert top(spark, []) == []
    assert top(spark, [(50, [1.0])]) == []
    assert top(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert top(spark, [(0, [-1e15, 3.0]), (1, [1e16, 1.0]), (2, [1e16, 2.0])]) == [
        (0, 1, 1, -2**63), (0, 2, 2, -2**63)]  # scores that a long cannot hold saturate and tie


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 60, (500, 7))).astype(np.int64)
    x[:, 3] = 4  # a constant component
    cells = vafile.Cells(x[:40], x.min(0), x.max(0), 8)
    middle, half = cells.boxes(cells.encode(x))
    assert (np.abs(x - middle) <= half).all()


# --- trie -----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, path string, base long, kind int"


def rebuild(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}:{x}".encode()).digest()
    for v in convs.values():
        v.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t[1], t[2])))
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = [x[1:] for x in convs.get(base, [])[:h]] + [x[1:] for x in own[h:]]
    return out


def expected_trie(rows):
    whole, nodes = rebuild(rows), {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        is_leaf = lambda q: not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in nodes)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(whole[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
                    sum(is_leaf(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, shards=None):
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], TURNS).repartition(3)
    c = F.col("conv_id")
    paths = trie.rebuilt(trie.turns(df, c - c % 5), F.crc32(c.cast("string").cast("binary")) % 9)
    return sorted((tuple(r) for r in trie.nodes(paths, shards).collect()), key=str)


def random_rows(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, convs):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 2))) or None))
    return rows


@pytest.mark.parametrize("shards", [1, 4, 60])
def test_trie_matches_brute_force(spark, shards):
    rows = random_rows(shards, 60, ["ä", "b"])
    rows += [(1000 + i, t, "user", "same") for i in range(80) for t in range(3)]  # a group of copies
    rows += [(2000 + i, 0, "user", "hello") for i in range(40)] + [(2000 + i, 1, "user", f"own {i}") for i in range(40)]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (4, None, "user", "early"), (None, 0, "user", "nobody"), (7001, 0, None, None)]
    assert built(spark, rows, shards) == expected_trie(rows)


def test_trie_without_turns(spark):
    assert built(spark, []) == []
    # a conversation of one turn whose base is absent and whose h is positive has no turn left
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    want = [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert built(spark, [(c, 0, "user", "x")], 3) == want == expected_trie([(c, 0, "user", "x")])


def test_trie_pieces_of_ends(spark, monkeypatch):
    """Ids of a split group of copies are hashed in order, whatever the pieces."""
    rows = [(5 * i, 0, "user", "same") for i in range(3000)]
    assert built(spark, rows, 7) == expected_trie(rows)


def test_skeleton_is_bounded(spark):
    rows = random_rows(1, 80, ["a", "b"])
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], TURNS)
    c = F.col("conv_id")
    paths = trie.rebuilt(trie.turns(df, c), F.lit(0)).cache()
    small = trie.skeleton(paths, 16, limit=10 * trie.WIDTH)
    assert len(small.number) <= 11 and len(trie.skeleton(paths, 16).cuts) == 15
