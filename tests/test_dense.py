import numpy as np
import pytest

from gridloom.functions import fields
from gridloom.functions.kernels import GreenFill
from gridloom.operators import dense
from gridloom.plans.spec import Center, Diff, Equation, GridSpec, Kernel

# Errors (L2, max) of the manufactured problem with 8 cells along each axis, cell-centred, kernel CHAT_2, by boundary code
ERRORS = {
    "440033": (2.564263296323e-01, 6.667615201541e-01),
    "334433": (2.564263296323e-01, 6.667615201541e-01),
    "044444": (5.376559477960e-03, 3.460073803785e-02),
    "334444": (7.308216077284e-03, 3.247800183326e-02),
    "440000": (7.305043924447e-02, 1.897605061812e-01),
    "004444": (7.388751115285e-03, 2.974730396831e-02),
    "004433": (2.476122640802e-01, 6.838381790615e-01),
    "044499": (1.049923727187e-02, 4.540393404512e-02),
    "404144": (4.441091413357e-03, 4.433228249174e-02),
    "334499": (4.992446487147e-02, 1.135798757980e-01),
    "104433": (2.512962482362e-01, 7.040554166554e-01),
}


def errors(code, n=8, kernel=Kernel.CHAT_2, center=Center.CELL):
    g = GridSpec.of(code, (n, n, 1) if code.endswith("99") else n, center)
    s = 0.5 if center == Center.CELL else 0.0
    x = np.meshgrid(*[(np.arange(p.n) + s) * p.h for p in g.axes], indexing="ij")
    rhs, sol = fields.manufactured(g, x, np)
    e = dense.solve(g, rhs[None], kernel)[0] - sol
    return np.sqrt((e**2).sum() * g.volume), np.abs(e).max()


@pytest.mark.parametrize("code", sorted(ERRORS))
def test_known_errors(code):
    assert errors(code) == pytest.approx(ERRORS[code], rel=1e-10)


@pytest.mark.parametrize("center", list(Center))
@pytest.mark.parametrize("code", ["000000", "010101", "333333", "113300", "100133", "003399", "011099"])
def test_spectral_problems_are_exact(code, center):
    assert errors(code, 16, Kernel.CHAT_2, center)[1] < 1e-12


ORDERS = [("CHAT_2", "444444", 1.5), ("LGF_2", "444444", 1.7), ("LGF_4", "404099", 3.4), ("LGF_6", "404099", 5.0), ("MEHR_4F", "443333", 3.4),
          ("MEHR_6F", "443333", 5.2), ("MEHR_4F", "444499", 3.4), ("HEJ_6", "444444", 3.2), ("HEJ_8", "444444", 4.6), ("HEJ_10", "334444", 5.5), ("HEJ_4", "331499", 2.4)]


@pytest.mark.parametrize("kernel,code,order", ORDERS)
def test_convergence(kernel, code, order):
    sizes = (32, 64) if code.endswith("99") else (16, 32)
    a, b = (errors(code, n, Kernel[kernel])[1] for n in sizes)
    assert np.log2(a / b) > order


def test_cutoff_kernel_and_its_limits():
    assert errors("444444", 16, Kernel.HEJ_0)[1] < 1e-4
    with pytest.raises(ValueError):
        errors("443333", 8, Kernel.HEJ_0)
    with pytest.raises(ValueError):
        dense.green(GridSpec.of("444444", (8, 8, 4)), Kernel.LGF_2)


@pytest.mark.parametrize("center", list(Center))
@pytest.mark.parametrize("code", ["333333", "444444", "003344"])
def test_linear(code, center):
    g = GridSpec.of(code, 8, center)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 1, *g.shape))
    u = lambda f: dense.solve(g, f, Kernel.CHAT_2)
    assert np.allclose(u(2 * a - 3 * b), 2 * u(a) - 3 * u(b), atol=1e-10)


@pytest.mark.parametrize("diff", [Diff.SPE, Diff.FD2, Diff.FD4, Diff.FD6])
@pytest.mark.parametrize("center", list(Center))
def test_periodic_curl(diff, center):
    """u of lap u = curl f against its closed form."""
    n = 32
    g = GridSpec.of("333333", n, center, components=3)
    s = 0.5 if center == Center.CELL else 0.0
    x, y, z = np.meshgrid(*[(np.arange(p.n) + s) * p.h for p in g.axes], indexing="ij")
    k = 2 * np.pi
    f = np.stack([np.sin(k * y), np.sin(k * z), np.sin(k * x)])
    u = dense.solve(g, f, Kernel.CHAT_2, Equation.ROT, diff)
    exact = np.stack([np.cos(k * z) / k, np.cos(k * x) / k, np.cos(k * y) / k])  # -curl f / k^2
    error = np.abs(u - exact).max()
    assert error < {Diff.SPE: 1e-12, Diff.FD2: 2e-3, Diff.FD4: 1e-5, Diff.FD6: 1e-7}[diff]


@pytest.mark.parametrize("center", list(Center))
def test_symmetric_curl(center):
    """Even and odd sides along the first two axes: f = (0, 0, F) with F odd, so u = (dF/dy, -dF/dx, 0) / -k^2."""
    n = 16
    odd, free = (1, 1), (3, 3)
    g = GridSpec((n, n, n), ((odd, odd, free),) * 3, center=center, components=3)
    s = 0.5 if center == Center.CELL else 0.0
    x, y, _ = np.meshgrid(*[(np.arange(p.n) + s) * p.h for p in g.axes], indexing="ij")
    k = np.pi
    f = np.stack([0 * x, 0 * x, np.sin(k * x) * np.sin(2 * k * y)])
    sides = (((0, 0), odd, free), (odd, (0, 0), free), (odd, odd, free))  # each component with the condition its curl needs
    g = GridSpec((n, n, n), sides, center=center, components=3)
    u = dense.solve(g, f, Kernel.CHAT_2, Equation.ROT, Diff.SPE)
    k2 = 5 * k * k
    exact = np.stack([-2 * k * np.sin(k * x) * np.cos(2 * k * y) / k2, k * np.cos(k * x) * np.sin(2 * k * y) / k2, 0 * x])
    assert np.abs(u - exact).max() < 1e-12


def test_unbounded_solution_is_a_sum_over_sources():
    g = GridSpec.of("444444", 4)
    f = np.random.default_rng(2).normal(size=(1, *g.shape))
    fill = GreenFill(g, Kernel.CHAT_2)
    i = np.stack(np.indices(g.shape)).reshape(3, -1)
    d = np.abs(i[:, :, None] - i[:, None, :])
    direct = (fill.sample(*d) @ f[0].ravel()) * g.volume
    assert np.allclose(dense.solve(g, f, Kernel.CHAT_2)[0].ravel(), direct, atol=1e-12)
