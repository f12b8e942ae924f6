import random

import numpy as np
import pytest

from gridloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n string, whitened int, i int"


def brute(rows, d, k=8):
    """n, deviations, covariance's eigenpairs, from integers one by one."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [int(np.floor(float(np.float32(c)) * 1024)) + 100_000 for c in v]))
    n = len(kept)
    s = [sum(x[j] for _, x in kept) for j in range(d)]
    v = [[sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for _, x in kept) / n**3 for b in range(d)] for a in range(d)]
    e, u = np.linalg.eigh(np.array(v))
    e, u = e[::-1], u[:, ::-1].T
    out = {}
    for i, x in kept:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        y = np.array([(n * a - b) / n for a, b in zip(x, s)])
        out.setdefault(i, []).append((dev, [float(y @ u[j] / np.sqrt(e[j])) if e[j] > 1e-9 * e[0] else 0.0 for j in range(min(k, d))]))
    return n, out, [x / e.sum() for x in e[:k]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA).repartition(3)


def check(spark, rows, d):
    n, want, explained = brute(rows, d)
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == n * min(8, d)
    signs = {}
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-6
        assert r["explained"] == pytest.approx(max(explained[r["component"] - 1], 0), rel=1e-9, abs=1e-12)
    for i, rs in by.items():
        for j in range(1, min(8, d) + 1):
            mine = sorted((r["deviation"], abs(r["whitened"])) for r in rs if r["component"] == j)
            other = sorted((dev, abs(w[j - 1])) for dev, w in want[i])
            assert [a for a, _ in mine] == [a for a, _ in other]
            assert [b for _, b in mine] == pytest.approx([b for _, b in other], abs=1e-7)
        for r in rs:
            w = want[i][0][1][r["component"] - 1]
            if len(want[i]) == 1 and abs(w) > 1e-3:  # either sign, the same for all rows
                assert signs.setdefault(r["component"], r["whitened"] * w > 0) == (r["whitened"] * w > 0)


def test_against_integers_one_by_one(spark):
    rng = random.Random(3)
    scale = [1 + 0.3 * j for j in range(11)]
    rows = [(i, [rng.gauss(0, s) for s in scale]) for i in range(200)]
    rows += [(200, None), (201, []), (202, [1.0] * 3), (203, [float("nan")] + [0.0] * 10), (204, [float("inf")] + [0.0] * 10), (205, [None] + [0.0] * 10), (None, rows[0][1]), (7, rows[7][1]), (7, rows[8][1])]
    check(spark, rows, 11)


def test_fewer_dimensions_than_components(spark):
    rng = random.Random(4)
    check(spark, [(i, [rng.random(), rng.random() * 2, -rng.random() * 3]) for i in range(50)], 3)


def test_large_numbers_stay_exact(spark):
    """A common offset of 2^30 would swamp the variance of rounded sums."""
    rng = random.Random(5)
    rows = [(i, [2.0**20 * rng.randrange(-4, 4), 2.0**12 * rng.randrange(9), float(rng.randrange(99))]) for i in range(40)]
    n, want, _ = brute(rows, 3)
    got = W.whiten(frame(spark, rows)).where("component = 1").collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: (v[0][0] if v[0][0] < 1 << 63 else None) for i, v in want.items()}
    assert all(r["identity_error"] < 1e-6 for r in got)


def test_huge_entries(spark):
    rows = [(i, [3e38 if i == 0 else 1.0 * i, 2.0]) for i in range(9)]
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 18 and all(np.isfinite(r["whitened"]) for r in got)
    first = {r["vec_id"]: r["whitened"] for r in got if r["component"] == 1}
    assert abs(first[0]) == pytest.approx(np.sqrt(8)) and all(abs(first[i]) == pytest.approx(1 / np.sqrt(8)) for i in range(1, 9))
    assert all(r["deviation"] is None for r in got)


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]])
def test_no_variance(spark, rows):
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 2 * len(rows) and all(r["whitened"] == r["explained"] == r["deviation"] == 0 for r in got)


def test_nothing_remains(spark):
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scatter_does_not_depend_on_the_shift(spark):
    rng = np.random.default_rng(1)
    for top in (50, 1 << 28, 1 << 40):
        y = rng.integers(-top, top, (30, 4))
        for shift in (0, 12345, -(1 << 35)):
            z = y.astype(object) - shift
            m = W.Moments(30, [int(v) for v in z.sum(axis=0)], [[int(v) for v in r] for r in W.products(z if top > 1 << 30 else z.astype(np.int64))])
            exact = [[int(30 * (y[:, a].astype(object) * y[:, b]).sum() - y[:, a].astype(object).sum() * y[:, b].astype(object).sum()) for b in range(4)] for a in range(4)]
            assert m.scatter() == exact
    for v in (0, 1, -1, 1 << 30, -(1 << 95) - 77):
        assert sum(x << W.LIMB * k for k, x in enumerate(W.limbs(v))) == v
