import numpy as np
import pytest

from gridloom.functions import transforms as T
from gridloom.operators import longline, report


def table(spark, lines, extra=False):
    rows = [(r, i, float(v.real), float(v.imag)) for r, line in lines.items() for i, v in enumerate(line)]
    return spark.createDataFrame(rows, "rhs_id long, i long, re double, im double").repartition(3)


def modes(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r["rhs_id"], np.full(n, np.nan, complex))[r["k"]] = r["re"] + 1j * r["im"]
    return out


@pytest.mark.parametrize("n,panel", [(1, 9), (7, 9), (12, 1), (60, 20), (64, 1 << 18), (720, 100)])
def test_equals_one_transform(spark, n, panel):
    rng = np.random.default_rng(n)
    lines = {0: rng.normal(size=n) + 1j * rng.normal(size=n), 1 << 40: rng.normal(size=n) + 0j}
    df = table(spark, lines)
    got = modes(longline.dft(df, n, panel=panel), n)
    back = modes(longline.dft(df, n, 1, panel), n)
    for r, line in lines.items():
        assert np.allclose(got[r], np.fft.fft(line), atol=1e-10) and np.allclose(back[r], np.fft.ifft(line, norm="forward"), atol=1e-10)


def test_one_exchange_between_and_gaps(spark):
    df = spark.createDataFrame([(0, 3, 1.5), (0, 3, 0.5), (0, 11, None), (0, 20, -1.0)], "rhs_id long, i long, re double")
    out = longline.dft(df, 24)
    assert len(report.exchanges(out)) == 2
    x = np.zeros(24)
    x[3], x[20] = 2.0, -1.0
    assert np.allclose(modes(out, 24)[0], np.fft.fft(x), atol=1e-12)
    assert longline.dft(df.limit(0), 24).count() == 0


def test_factors():
    assert [longline.factors(n) for n in (1, 7, 12, 43_200)] == [(1, 1), (1, 7), (3, 4), (200, 216)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_half_empty_lines_are_never_padded(n):
    """Lines of n or n + 1 points among 2n: the same as a transform of the padded line, there and back."""
    rng = np.random.default_rng(n)
    for points in (n, n + 1):
        x = rng.normal(size=(3, points))
        z = x + 1j * rng.normal(size=x.shape)
        full = lambda v: np.concatenate([v, np.zeros((3, 2 * n - points))], -1)
        assert np.allclose(T.padded_forward(x, n, True), np.fft.rfft(full(x))) and np.allclose(T.padded_forward(z, n, False), np.fft.fft(full(z)))
        y, half = (rng.normal(size=(3, m)) + 1j * rng.normal(size=(3, m)) for m in (2 * n, n + 1))
        assert np.allclose(T.padded_backward(y, n, points, False), np.fft.ifft(y, norm="forward")[..., :points])
        assert np.allclose(T.padded_backward(half, n, points, True), np.fft.irfft(half, 2 * n, norm="forward")[..., :points])
