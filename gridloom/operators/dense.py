"""The whole solve on one dense field: what a single task does for a field that fits in it."""

from __future__ import annotations

import numpy as np

from gridloom.functions import transforms as T
from gridloom.functions.kernels import GreenFill
from gridloom.plans.spec import Diff, Equation, GridSpec, Kernel


def along(f, x: np.ndarray, axis: int) -> np.ndarray:
    """Apply a transform of last-axis lines along another axis."""
    return np.moveaxis(f(np.moveaxis(x, axis, -1)), -1, axis)


def green(grid: GridSpec, kernel: Kernel, alpha: float = 2.0) -> np.ndarray:
    """Green's function on the spectral grid, scaled to the transforms."""
    fill = GreenFill(grid, kernel, alpha)
    shape = fill.shape()
    g = np.array(np.broadcast_to(fill.sample(*np.ogrid[tuple(map(slice, shape))]), shape))
    for d in grid.order:
        p = grid.axes[d]
        if p.unbounded:
            g = along(lambda x, p=p, d=d: T.green_forward(p, x, grid.half(d)), g, d)
    g *= grid.volfact
    return fill.overwrite(*np.ogrid[tuple(map(slice, grid.modes))], g)


def forward(grid: GridSpec, f: np.ndarray) -> np.ndarray:
    """Modes of a field (components, n0, n1, n2), not normalised."""
    out = []
    for c in range(grid.components):
        x = f[c]
        for d in grid.order:
            x = along(lambda y, d=d: T.forward(grid.plan(d, c), y, grid.half(d)), x, d)
        out.append(x)
    return np.stack(out) if len(out) > 1 else out[0][None]


def backward(grid: GridSpec, y: np.ndarray, derived: bool = False) -> np.ndarray:
    """Field of modes; ``derived`` uses the conditions of a derivative."""
    out = []
    for c in range(grid.components):
        x = y[c]
        for d in reversed(grid.order):
            p = grid.plan(d, c)
            x = along(lambda z, p=p, d=d: T.backward(p.derived() if derived else p, z, grid.half(d)), x, d)
        out.append(x.real)
    return np.stack(out) if len(out) > 1 else out[0][None]


#: finite-difference symbols of the first derivative: weights of sin(m k h) (fixed values)
FIRST = {Diff.FD2: (1.0,), Diff.FD4: (4 / 3, -1 / 6), Diff.FD6: (3 / 2, -3 / 10, 1 / 30)}


def derivative_factor(diff: Diff, k, h: float, lib=np):
    """Real factor kappa(k) of a first derivative; ``lib`` offers sin (numpy or Spark functions)."""
    if diff == Diff.SPE or h == 0:
        return k
    total = 0.0
    for m, w in enumerate(FIRST[diff], 1):
        total = total + lib.sin(k * (m * h)) * (w / h)
    return total


def phase(grid: GridSpec, axis: int, component: int, target: int) -> complex:
    """Factor that a derivative along ``axis`` of ``component`` takes when it lands in component ``target``:
    cosine modes turn to minus sine modes, sine modes to cosine modes, and complex modes turn by i."""
    p = grid.plan(axis, component)
    if p.complex or p.kind.name == "EMPTY":
        return 1j
    return 1.0 if p.odd else -1.0


def curl(grid: GridSpec, fill: GreenFill, y: np.ndarray, diff: Diff, index=None) -> np.ndarray:
    """Curl of three components at the modes ``index`` of each axis (all of them by default)."""
    index = index or [np.arange(n) for n in grid.modes]
    k = [derivative_factor(diff, fill.wave(d, index[d]), grid.h[d]) for d in range(3)]
    k = [np.reshape(x, [-1 if a == d else 1 for a in range(3)]) for d, x in enumerate(k)]
    d = lambda axis, c, to: phase(grid, axis, c, to) * k[axis] * y[c]
    return np.stack([d(1, 2, 0) - d(2, 1, 0), d(2, 0, 1) - d(0, 2, 1), d(0, 1, 2) - d(1, 0, 2)])


def solve(grid: GridSpec, f: np.ndarray, kernel: Kernel, equation: Equation = Equation.STD, diff: Diff = Diff.NOD, alpha: float = 2.0, spectral=None, g=None) -> np.ndarray:
    """Solution of the Poisson (or rotational) problem for a field (components, n0, n1, n2)."""
    if equation == Equation.ROT and (grid.components != 3 or diff == Diff.NOD):
        raise ValueError("the rotational equation needs three components and a derivative")
    g = green(grid, kernel, alpha) if g is None else g
    y = forward(grid, f)
    if equation == Equation.ROT:
        y = curl(grid, GreenFill(grid, kernel, alpha), y, diff)
    y *= g  # in place: these arrays are the memory of a solve
    y *= grid.normfact
    if spectral is not None:
        y = spectral(y)
    return backward(grid, y, equation == Equation.ROT)
