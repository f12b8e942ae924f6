import numpy as np
import pytest

from gridloom.functions import special as S
from gridloom.functions import transforms as T
from gridloom.plans.spec import BC, AxisClass, Center, GridSpec, Kernel, classify, sym_id


def by_sum(name, x):
    n = x.shape[-1]
    j, k = np.arange(n), np.arange(n)[:, None]
    y = x[:, None]
    pi = np.pi
    return {
        "dct1": lambda: x[:, :1] + (-1.0) ** k[:, 0] * x[:, -1:] + 2 * (y[..., 1:-1] * np.cos(pi * j[1:-1] * k / (n - 1))).sum(-1),
        "dct2": lambda: 2 * (y * np.cos(pi * (j + 0.5) * k / n)).sum(-1),
        "dct3": lambda: x[:, :1] + 2 * (y[..., 1:] * np.cos(pi * j[1:] * (k + 0.5) / n)).sum(-1),
        "dct4": lambda: 2 * (y * np.cos(pi * (j + 0.5) * (k + 0.5) / n)).sum(-1),
        "dst1": lambda: 2 * (y * np.sin(pi * (j + 1) * (k + 1) / (n + 1))).sum(-1),
        "dst2": lambda: 2 * (y * np.sin(pi * (j + 0.5) * (k + 1) / n)).sum(-1),
        "dst3": lambda: (-1.0) ** k[:, 0] * x[:, -1:] + 2 * (y[..., :-1] * np.sin(pi * (j[:-1] + 1) * (k + 0.5) / n)).sum(-1),
        "dst4": lambda: 2 * (y * np.sin(pi * (j + 0.5) * (k + 0.5) / n)).sum(-1),
    }[name]()


@pytest.mark.parametrize("name", ["dct1", "dct2", "dct3", "dct4", "dst1", "dst2", "dst3", "dst4"])
@pytest.mark.parametrize("n", [2, 5, 16])
def test_real_transform_is_its_sum(name, n):
    x = np.random.default_rng(n).normal(size=(3, n))
    assert np.allclose(getattr(T, name)(x), by_sum(name, x), atol=1e-12)


@pytest.mark.parametrize("center", list(Center))
@pytest.mark.parametrize("sides", [(a, b) for a in (0, 1, 4) for b in (0, 1, 4)] + [(3, 3)])
def test_round_trip(center, sides):
    p = GridSpec.of(f"{sides[0]}{sides[1]}0000", 8, center).plan(0)
    x = np.random.default_rng(1).normal(size=(4, p.n))
    if center == Center.NODE:  # values that the conditions fix
        x[:, 0] = 0 if p.left == BC.ODD else x[:, 0]
        x[:, -1] = 0 if p.right == BC.ODD else x[:, 0] if p.kind == AxisClass.PERPER else x[:, -1]
    for half in ({True, False} if p.complex else {False}):
        y = T.forward(p, x if half or not p.complex else x.astype(complex), half)
        assert y.shape[-1] == p.modes(half)
        assert np.allclose(T.backward(p, y, half) * p.normfact, x, atol=1e-12)


@pytest.mark.parametrize("pair", [(0, 3), (1, 3), (3, 4), (4, 9), (0, 9)])
def test_impossible_sides(pair):
    with pytest.raises(ValueError):
        classify(BC(pair[0]), BC(pair[1]))


def test_mirrored_index():
    assert [sym_id(e, 4) for e in range(8)] == [0, 1, 2, 3, 4, -3, -2, -1]
    assert [sym_id(e, 4, signed=False) for e in range(8)] == [0, 1, 2, 3, 4, 3, 2, 1]
    assert [sym_id(e, 0) for e in range(3)] == [0, 1, 2]


def test_special_functions():
    # fixed values of public tables
    assert np.allclose(S.e1([0.1, 1.0, 2.5, 10.0]), [1.8229239584, 0.2193839344, 0.0249149178, 4.15696893e-06], rtol=1e-8)
    assert np.allclose(S.si([0.5, 1.0, 5.0, 20.0]), [0.4931074180, 0.9460830704, 1.5499312449, 1.5482417010], rtol=1e-9)
    assert np.allclose(S.bessel_k(0, [0.1, 1.0, 5.0]), [2.4270690247, 0.4210244382, 0.0036910983], rtol=1e-8)
    assert np.allclose(S.bessel_k(1, [0.1, 1.0, 5.0]), [9.8538447809, 0.6019072302, 0.0040446134], rtol=1e-8)
    x = np.linspace(0, 7, 20001)
    j0 = np.mean([np.cos(x * np.sin(t)) for t in (np.arange(64) + 0.5) * np.pi / 128], axis=0)
    integrand = np.where(x > 0, (1 - j0) / np.where(x > 0, x, 1), 0)
    assert abs(S.ji0c(np.array([7.0]))[0] - np.trapezoid(integrand, x)) < 1e-7


@pytest.mark.parametrize("kernel", [k for k in Kernel if k.family in ("LGF", "MEHR")])
def test_lattice_line_inverts_its_stencil(kernel):
    """A periodic sum over wave numbers of 1 / symbol gives the same values."""
    k0, k1, n = 1.3, 2.1, np.arange(6.0)
    k = 2 * np.pi * np.arange(4096) / 4096
    from gridloom.functions.kernels import spectral

    h = (1.0, 1.0, 1.0)
    g = -spectral(kernel, [np.full_like(k, k0), np.full_like(k, k1), k], 0.0, h)
    direct = [(g * np.cos(k * m)).mean() for m in n]
    assert np.allclose(S.line(kernel, n, k0, k1), direct, atol=1e-12)


def test_lattice_tables():
    # Watson's integral and the exact plane values (fixed values)
    assert abs(S.table3(Kernel.LGF_2, 4)[0, 0, 0] - 0.252731009859) < 1e-9
    t = S.table2(Kernel.LGF_2, 3)
    assert abs(t[1, 0] + 0.25) < 1e-9 and abs(t[1, 1] + 1 / np.pi) < 1e-7
    t = S.table3(Kernel.LGF_2, 4)
    assert abs(6 * t[0, 0, 0] - 6 * t[1, 0, 0] - 1) < 1e-8
