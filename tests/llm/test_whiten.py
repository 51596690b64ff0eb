"""Whitening of embeddings."""

from fractions import Fraction

import numpy as np
import pytest

from gridlens.llm import whiten

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("x", "n", "d", "component", "whitened", "salt", "high")})


def plain(rows, components=4):
    """The same by exact sums and a solver of numpy's on the exact covariance."""
    fine = [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for d in {len(x) for _, x in fine}:
        own = [(i, x) for i, x in fine if len(x) == d]
        fit = sorted({tuple(x) for _, x in own})
        n = len(fit)
        s = [sum(c) for c in zip(*fit)]
        u = np.array([[n * c - t for c, t in zip(x, s)] for x in fit], dtype=object)
        v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in u.T.dot(u)])
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        for i, x in own:
            c = np.array([float(Fraction(n * a - t, n)) for a, t in zip(x, s)])
            dev = sum((n * a - t) ** 2 for a, t in zip(x, s))
            for k in range(len(values)):
                out.setdefault((i, d), []).append((k + 1, n, dev, c @ vectors[:, k] / np.sqrt(values[k]) if values[k] > 1e-9 else None, values[k] / np.trace(v) if np.trace(v) else 0.0))
    return out


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (300, 9)) * np.array([3, 2, 1.5, 1.2, 1, 0.5, 0.4, 0.2, 0.1]) + 5
    rows = [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1], None) for i in range(120)]  # a third are copies
    rows += [(2000, None, 1), (2001, [1.0, None] * 4 + [1.0], 1), (2002, [NAN] + [0.0] * 8, 1), (2003, [INF] + [0.0] * 8, 1), (2004, [], 1), (None, rows[3][1], 0), rows[5]]
    rows += [(3000 + i, [float(i), float(i * i), -float(i)], 0) for i in range(6)]  # of another length, on a plane
    rows += [(4000, [0.25, -0.25], 0)]  # alone
    want = plain(rows)
    got = whiten.whitening(table(spark, rows)).collect()
    seen = {}
    for r in got:
        seen.setdefault((r["vec_id"], r["n"]), []).append(r)
    count = 0
    for (vec_id, d), parts in want.items():
        own = sorted(seen[vec_id, parts[0][1]], key=lambda r: r["component"])
        times = len(own) // len({r["component"] for r in own})
        for r in own:
            k, n, dev, w, share = parts[r["component"] - 1]
            assert (r["n"], r["deviation"]) == (n, dev)
            assert r["explained"] == pytest.approx(share, rel=1e-9, abs=1e-12)
            if w is None:
                assert r["whitened"] is None
            else:
                assert abs(r["whitened"]) == pytest.approx(abs(w), rel=1e-8, abs=1e-8)
                assert r["identity_error"] < 1e-9
            count += 1
        assert times == (2 if vec_id == rows[5][0] else 1)
    assert count == len(got)


def test_whitening_is_exact_to_doubles_far_from_zero(spark):
    """Entries near 2**40 with spread of a few units: plain double covariance loses all digits."""
    rng = np.random.default_rng(6)
    spread = rng.integers(-40, 40, (500, 3)) * np.array([5, 2, 1])
    x = (1 << 40) + spread
    space = whiten.Space(500, [int(s) for s in x.sum(axis=0)])
    sums = whiten.Products(500, space.sums)
    sums.add(x)
    u = np.array([[500 * int(c) - s for c, s in zip(row, space.sums)] for row in x.tolist()], dtype=object)
    exact = u.T.dot(u)
    for i in range(3):
        for j in range(3):
            said = Fraction(sums.high[i, j]) + Fraction(sums.low[i, j])
            true = Fraction(int(exact[i, j]), 500**2)
            assert abs(said - true) <= abs(Fraction(int(exact[i, i]), 500**2)) * Fraction(1, 1 << 80)
    space.solve(sums.high, sums.low, 3)
    w = space.whitened(x)
    assert np.allclose(w.T @ w / 500, np.eye(3), atol=1e-12)
    assert space.deviations(x) == [sum(int(c) ** 2 for c in row) for row in u]


def test_error_free_steps():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=1000) * 10.0 ** rng.integers(-9, 9, 1000), rng.normal(size=1000)
    s, e = whiten.two_sum(a, b)
    assert all(Fraction(p) + Fraction(q) == Fraction(x) + Fraction(y) for p, q, x, y in zip(s, e, a, b))
    high, low = whiten.as_doubles(np.array([2**63 - 1, -(2**63), 12345, -1], np.int64))
    assert [int(Fraction(h) + Fraction(l)) for h, l in zip(high, low)] == [2**63 - 1, -(2**63), 12345, -1]
    x = rng.normal(size=(256, 4))
    parts = whiten.slices_of(x, np.zeros_like(x))
    assert np.abs(sum(parts) - x).max() < 1e-15
    exact = sum(Fraction(float(p)) * Fraction(float(q)) for p, q in zip(parts[0][:, 0], parts[0][:, 1]))
    assert Fraction(float((parts[0].T @ parts[0])[0, 1])) == exact  # no rounding in the product of slices


def test_eigen_of_close_values():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    values = np.sort(rng.uniform(1, 2, 30))[::-1]
    values[1] = values[0] * (1 - 1e-6)
    wide = (q.astype(np.longdouble) * values) @ q.T.astype(np.longdouble)
    high = wide.astype(float)
    got, vectors = whiten.eigen(high, (wide - high).astype(float))
    assert np.allclose(got, values, rtol=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(30)).max() < 1e-14
    for k in range(4):
        assert np.abs(wide.astype(float) @ vectors[:, k] - got[k] * vectors[:, k]).max() < 1e-14


def test_whitening_of_nothing_and_of_many_lengths(spark, monkeypatch):
    assert whiten.whitening(table(spark, [(1, None, 0)])).count() == 0
    rows = [(i, [1.0] * (i + 1), 0) for i in range(3)]
    assert {(r["vec_id"], r["whitened"], r["explained"], r["deviation"]) for r in whiten.whitening(table(spark, rows)).collect()} == {(i, None, 0.0, 0) for i in range(3)}
    monkeypatch.setattr(whiten, "MOST_LENGTHS", 2)
    with pytest.raises(ValueError):
        whiten.whitening(table(spark, rows))


def test_deviation_beyond_64_bits():
    space = whiten.Space(2, [2**62, 0])
    x = np.array([[2**62 - 1, 3], [2**61, 0]], np.int64)
    assert space.deviations(x) == [None, 0]
