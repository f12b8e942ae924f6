"""Lattice functions near and far, and the error function, against other ways to compute them."""

import itertools
import math

import numpy as np
import pytest

from gridloom import kernel_queries
from gridloom.functions import special
from gridloom.functions.farfield import far
from gridloom.functions.kernels import LATTICE_REACH, GreenFill
from gridloom.plans.spec import GridSpec, Kernel

LATTICE = kernel_queries.LATTICE


@pytest.mark.parametrize("kernel", LATTICE)
def test_far_field_meets_the_integral(kernel):
    t = special.table3(kernel, LATTICE_REACH)
    at = np.array([(40, 0, 0), (33, 7, 2), (30, 30, 30), (48, 48, 48), (48, 20, 1)]).T
    assert far(kernel, *at) == pytest.approx(t[tuple(at)], rel=1e-11)
    assert far(kernel, *at[[2, 0, 1]]) == pytest.approx(t[tuple(at)], rel=1e-11)
    t = special.table2(kernel, LATTICE_REACH)
    gap = t[at[0], at[1]] - far(kernel, *at[:2])
    assert np.ptp(gap) < 1e-12


def test_far_field_meets_a_long_integral():
    """Offsets 100 to 130, integrated with as many nodes as those need."""
    t = special.table2(Kernel.LGF_4, 130)
    at = np.array(list(itertools.product((100, 117, 130), (0, 60, 130)))).T
    gap = t[tuple(at)] - far(Kernel.LGF_4, *at)
    assert np.ptp(gap) < 1e-11
    assert (t[50, 3] - far(Kernel.LGF_4, 50.0, 3.0)) == pytest.approx(gap[0], abs=1e-11)


@pytest.mark.parametrize("kernel", LATTICE)
@pytest.mark.parametrize("code", ["444444", "444499"])
def test_operator_gives_back_the_source_at_any_offset(kernel, code):
    axes = 3 if code == "444444" else 2
    fill = GreenFill(GridSpec.of(code, (400, 400, 400 if axes == 3 else 1)), kernel)
    operator, source = kernel_queries._stencils(kernel, axes)
    for at in [(0, 0, 0), (1, 0, 0), (1, 1, 0), (2, 0, 0), (47, 3, 1), (48, 48, 2), (49, 0, 0), (161, 5, 0), (200, 200, 200), (399, 0, 7)]:
        total = sum(w * fill._lattice([np.array([float(abs(x + s))]) for x, s in zip(at, o)])[0] for o, w in operator.items())
        assert total == pytest.approx(source.get(at[:axes], 0.0), abs=2e-11), at


def test_known_lattice_values():
    assert special.table3(Kernel.LGF_2, 8)[0, 0, 0] == pytest.approx(0.252731009858663, abs=1e-12)
    t = special.table2(Kernel.LGF_2, 8)
    assert t[1, 0] == pytest.approx(-0.25, abs=1e-12) and t[1, 1] == pytest.approx(-1 / math.pi, abs=1e-12)


def test_fill_carries_its_table():
    import pickle

    fill = GreenFill(GridSpec.of("444444", 8), Kernel.LGF_2)
    again = pickle.loads(pickle.dumps(fill))
    assert again._table is not None and (again._table == fill.table).all()


def test_error_function():
    x = np.concatenate([np.linspace(-9, 9, 20_001), [0.0, 3.0, -3.0, 40.0, -1e3, 1e-300]])
    assert special.erf(x) == pytest.approx([math.erf(v) for v in x], rel=1e-14, abs=1e-300)


@pytest.mark.parametrize("sides", ["0011", "0110"])
def test_components_must_share_transform_families(sides):
    from gridloom.plans.spec import BC

    pair = lambda c: tuple((BC(int(c[2 * k])), BC(int(c[2 * k + 1]))) for k in range(3))
    with pytest.raises(ValueError):
        GridSpec((4, 4, 4), (pair("333333"), pair(f"{sides}33"), pair("333333")), components=3)
