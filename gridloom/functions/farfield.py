"""Lattice Green's functions far from the origin, for every stencil, from the Taylor series of its symbol.

With ``N / S`` the transform of a kernel, ``S = K + E`` and ``K = |k|^2``, the series ``N / K * sum (-E / K)^j`` is a sum
of polynomials over powers of ``K``.  Each inverts exactly: the polynomial becomes a differential operator on the
fundamental solution of a power of the Laplacian, which leaves a polynomial of the direction over a power of the
distance.  Nothing is tabulated or fitted but the constant of the plane, whose function vanishes at the origin."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from numpy.polynomial import polynomial as P

from gridloom.functions import special as S
from gridloom.plans.spec import Kernel

#: corrections kept; the first one left out falls off as the distance to the power -(2 TERMS + 3)
TERMS = 6


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials in the squared wave numbers, up to degree 2 TERMS."""
    out = np.zeros_like(a)
    for at in np.argwhere(b):
        i, j, k = at
        out[i:, j:, k:] += b[i, j, k] * a[: a.shape[0] - i, : a.shape[1] - j, : a.shape[2] - k]
    out[sum(np.indices(out.shape)) > 2 * TERMS] = 0
    return out


def _symbol(kernel: Kernel, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """(numerator, denominator) of the kernel's transform as polynomials in the squared wave numbers."""
    n = 2 * TERMS + 1
    shape = tuple(n if d < axes else 1 for d in range(3))

    def along(axis: int, line) -> np.ndarray:
        out = np.zeros(shape)
        out[tuple(slice(None) if d == axis else 0 for d in range(3))] = line
        return out

    def difference(m: int) -> np.ndarray:  # 2 - 2 cos(m k)
        return np.array([0.0] + [2 * (-1) ** (p + 1) * m ** (2 * p) / math.factorial(2 * p) for p in range(1, n)])

    one = np.zeros(shape)
    one[0, 0, 0] = 1
    if kernel.family == "LGF":
        return one, sum(along(d, c * difference(m)) for d in range(axes) for m, c in enumerate(S.SECOND[kernel.order], 1))
    y = [along(d, difference(1) / 4) for d in range(axes)] + [np.zeros(shape)] * (3 - axes)
    sums = y[0] + y[1] + y[2]
    pairs = _times(y[0], y[1]) + _times(y[1], y[2]) + _times(y[0], y[2])
    below = 4 * sums - 8 / 3 * pairs
    if kernel.order == 6:
        below = below + 32 / 15 * _times(_times(y[0], y[1]), y[2])
    top = one
    if kernel == Kernel.MEHR_4F:
        top = one - sums / 3
    elif kernel == Kernel.MEHR_6F:
        top = one - sums / 3 + 8 / 45 * pairs - sum(_times(v, v) for v in y) / 15
    return top, below


def _derivative(parts: tuple[np.ndarray, np.ndarray, int], axis: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of ``(q ln r + w) r^p`` along an axis, with q and w polynomials of the coordinates."""
    q, w, p = parts

    def shift(a: np.ndarray, d: int, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        to, of = [slice(None)] * 3, [slice(None)] * 3
        to[d], of[d] = slice(by, None), slice(None, -by)
        out[tuple(to)] = a[tuple(of)]
        return out

    def slope(a: np.ndarray) -> np.ndarray:
        size = a.shape[axis]
        power = np.arange(size).reshape([-1 if d == axis else 1 for d in range(3)])
        lower = np.roll(a * power, -1, axis)
        return sum(shift(lower, d, 2) for d in range(3) if a.shape[d] > 1)

    along = [shift(a, axis, 1) for a in (q, w)]
    return slope(q) + p * along[0], slope(w) + p * along[1] + along[0], p - 2


@lru_cache(maxsize=32)
def _series(kernel: Kernel, axes: int) -> list[np.ndarray]:
    """For each correction, its polynomial in the squared direction cosines."""
    top, below = _symbol(kernel, axes)
    degree = sum(np.indices(top.shape))
    rest = np.where(degree == 1, 0.0, -below)
    # coordinates appear in powers of up to twice the order of the operators, and two more on the way
    size = tuple(4 * TERMS + 4 if d < axes else 1 for d in range(3))
    out = [np.zeros(tuple(2 * TERMS + 2 if d < axes else 1 for d in range(3))) for _ in range(TERMS + 1)]
    power, weight = top, (1 / (4 * math.pi) if axes == 3 else -1 / (2 * math.pi))
    for j in range(TERMS + 1):
        if j:
            power = _times(power, rest)
            weight = -weight / ((2 * j - 1) * 2 * j) if axes == 3 else -weight / (2 * j) ** 2
        start = np.zeros(size)
        start[0, 0, 0] = weight
        base = (np.zeros(size), start, 2 * j - 1) if axes == 3 else (start, np.zeros(size), 2 * j)
        known = {(0, 0, 0): base}

        def operator(a: tuple[int, int, int], known=known) -> tuple[np.ndarray, np.ndarray, int]:
            if a not in known:
                d = max(k for k in range(3) if a[k])
                lower = tuple(v - (k == d) for k, v in enumerate(a))
                known[a] = _derivative(_derivative(operator(lower), d), d)
            return known[a]

        for a in map(tuple, np.argwhere((power != 0) & (degree - j <= TERMS)).tolist()):
            t = sum(a) - j
            if axes == 2 and t == 0:
                continue  # the logarithm itself
            w = operator(a)[1][tuple(slice(None, None, 2) if size[d] > 1 else slice(None) for d in range(3))]
            out[t] += (-1) ** sum(a) * power[a] * w
    return out


def far(kernel: Kernel, *offsets: np.ndarray) -> np.ndarray:
    """The kernel's function at lattice offsets of two or three axes; for two, without its constant."""
    n = [np.asarray(x, float) for x in offsets]
    r2 = sum(x * x for x in n)
    u = [x * x / r2 for x in n]
    series = _series(Kernel(kernel), len(n))
    out = np.zeros(np.shape(r2)) if len(n) == 3 else -0.25 / math.pi * np.log(r2)
    for t, poly in enumerate(series):
        value = P.polyval3d(*u, poly) if len(n) == 3 else P.polyval2d(*u, poly[:, :, 0])
        out = out + value / r2 ** (t + (0.5 if len(n) == 3 else 0.0))
    return out
