"""Green's functions of the Laplacian: values by number of unbounded axes, as numpy functions,
and the fully spectral ones as Spark column expressions too.

``GreenFill`` evaluates a kernel at raw indices of the layout in which it is sampled: positions
along unbounded axes, modes along the others."""

from __future__ import annotations

import math

import numpy as np

from gridloom.functions import special as S
from gridloom.functions.farfield import far
from gridloom.functions.transforms import green_line
from gridloom.plans.spec import AxisClass, GridSpec, Kernel

#: lattice tables are integrated up to this offset; the far field serves beyond, where its error is below 1e-13
LATTICE_REACH = 48

#: polynomials in rho of the regularised kernels (fixed values): 3 unbounded axes, odd powers; 2 unbounded axes, even powers
HEJ_3 = {2: (), 4: (1.0,), 6: (7 / 4, -1 / 4), 8: (19 / 8, -2 / 3, 1 / 24), 10: (187 / 64, -233 / 192, 29 / 192, -1 / 192)}
HEJ_3_ORIGIN = {2: 1.0, 4: 3 / 2, 6: 15 / 8, 8: 35 / 16, 10: 315 / 128}
HEJ_2 = {2: (), 4: (1 / 2,), 6: (3 / 4, -1 / 8), 8: (11 / 12, -7 / 24, 1 / 48), 10: (25 / 24, -23 / 48, 13 / 192, -1 / 384)}
HEJ_0_SERIES = (1.0, 1 / 2, 1 / 8, 1 / 48, 1 / 384)


def _poly(c, x):
    out = np.zeros_like(x)
    for a in reversed(c):
        out = out * x + a
    return out


def unbounded3(kernel: Kernel, r, eps: float, h):
    rho, zero = r / eps, r == 0
    safe = np.where(zero, 1.0, r)
    if kernel == Kernel.CHAT_2:
        v = h[0] * h[1] * h[2]
        g, origin = -1 / (4 * math.pi * safe), -0.5 * (3 * v / (4 * math.pi)) ** (2 / 3) / v
    elif kernel == Kernel.HEJ_0:
        g, origin = -S.si(rho) / (2 * math.pi**2 * safe), -1 / (2 * math.pi**2 * eps)
    else:
        p = rho * _poly(HEJ_3[kernel.order], rho**2) * np.exp(-(rho**2) / 2) / math.sqrt(2 * math.pi)
        g = -(p + S.erf(rho / math.sqrt(2))) / (4 * math.pi * safe)
        origin = -HEJ_3_ORIGIN[kernel.order] * math.sqrt(2) / (4 * eps * math.pi**1.5)
    return np.where(zero, origin, g)


def unbounded2(kernel: Kernel, r, k, eps: float, r_eq: float):
    """In the plane, for wave number k along the third axis (k = 0 in two dimensions)."""
    zero, still = r == 0, k == 0
    safe = np.where(zero, 1.0, r)
    log = np.log(safe) / (2 * math.pi)
    if kernel == Kernel.CHAT_2:
        ks = np.where(still, 1.0, np.abs(k))
        x = ks * r_eq
        origin = np.where(
            still, (math.pi - 6 + 2 * math.log(0.5 * math.pi * r_eq**2)) / (8 * math.pi), -(1 - x * S.bessel_k(1, x)) / (math.pi * x**2)
        )
        far = np.where(still, log, -S.bessel_k(0, ks * safe) / (2 * math.pi))
        return np.where(zero, origin, far)
    rho = r / eps
    if kernel == Kernel.HEJ_0:
        near = (S.ji0c(np.minimum(rho, 30.0)) + math.log(2 * eps) - S.GAMMA) / (2 * math.pi)
        return np.where(still | zero, np.where(rho < 30, near, log), 0.0)
    order = kernel.order
    t = np.where(zero, 1.0, rho**2 / 2)
    g = log + (0.5 * S.e1(t) - _poly(HEJ_2[order], rho**2) * np.exp(-(rho**2) / 2)) / (2 * math.pi)
    origin = -(S.GAMMA / 2 - math.log(math.sqrt(2) * eps) + (HEJ_2[order][0] if HEJ_2[order] else 0.0)) / (2 * math.pi)
    return np.where(zero, origin, np.where(still, g, 0.0))


def _hej_tail(order: int, s, q):
    """Polynomial of the last term with one unbounded axis; s = k sigma, q = r / sigma (fixed values)."""
    s2, q2 = s * s, q * q
    if order == 2:
        return 0 * s
    if order == 4:
        return 1 / 4 + 0 * s
    if order == 6:
        return 5 / 16 + (s2 - q2) / 16
    if order == 8:
        return 11 / 32 + s2 / 12 - q2 / 8 - s2 * q2 / 48 + (s2 * s2 + q2 * q2) / 96
    return (
        93 / 256 + 73 * s2 / 768 - 47 * q2 / 256 - 17 * s2 * q2 / 384 + 11 * s2**2 / 768 + 23 * q2**2 / 768
        + (s2 * q2**2 - s2**2 * q2) / 256 + (s2**3 - q2**3) / 768
    )


#: last term at k = 0: constant and even polynomial in rho (fixed values)
HEJ_1_STILL = {
    2: (1.0, (1.0,)), 4: (1 / 2, (1 / 2,)), 6: (3 / 8, (3 / 8, 1 / 8)), 8: (5 / 16, (5 / 16, 1 / 4, -1 / 48)),
    10: (35 / 128, (35 / 128, 47 / 128, -23 / 384, 1 / 384)),
}


def unbounded1(kernel: Kernel, r, k, eps: float):
    """Along a line, for the wave number k of the other axes."""
    r, still = np.abs(r), k == 0
    ks = np.where(still, 1.0, k)
    if kernel == Kernel.CHAT_2:
        return np.where(still, r / 2, -np.exp(-ks * r) / (2 * ks))
    if kernel == Kernel.HEJ_0:
        raise ValueError("HEJ_0 has no form with one unbounded axis")
    q, s = r / eps, ks * eps
    arg = s * q
    near = arg <= 100
    a = np.where(near, arg, 0.0)
    b = (1 - S.erf((s - q) / math.sqrt(2))) * np.exp(-a) + (1 - S.erf((s + q) / math.sqrt(2))) * np.exp(a)
    moving = -eps / (4 * s) * np.where(near, b, 0.0)
    moving -= math.sqrt(2 / math.pi) * eps * _hej_tail(kernel.order, s, q) * np.exp(-(s * s + q * q) / 2)
    const, even = HEJ_1_STILL[kernel.order]
    rest = 0.5 * r * S.erf(r / (math.sqrt(2) * eps)) - (const - np.exp(-q * q / 2) * _poly(even, q * q)) * eps / math.sqrt(2 * math.pi)
    return np.where(still, rest, moving)


def spectral(kernel: Kernel, k, eps: float, h, lib=np):
    """Fully spectral form at wave numbers ``k`` (three arrays or Columns); ``lib`` offers sin and exp.  The caller zeroes mode 0."""
    k2 = k[0] * k[0] + k[1] * k[1] + k[2] * k[2]
    if kernel in (Kernel.CHAT_2, Kernel.HEJ_0):
        return -1.0 / k2
    if kernel.family == "HEJ":
        q = k2 * (eps * eps)
        p = 0.0
        for c in reversed(HEJ_0_SERIES[: kernel.order // 2]):
            p = p * q + c
        return -1.0 * p * lib.exp(q * -0.5) / k2
    h0 = next(x for x in h if x)
    y = [lib.sin(x * (hx / 2)) * lib.sin(x * (hx / 2)) for x, hx in zip(k, h)]
    if kernel.family == "LGF":
        total = 0.0
        for x, hx in zip(k, h):
            for m, c in enumerate(S.SECOND[kernel.order], 1):
                s = lib.sin(x * (m * hx / 2))
                total = total + s * s * (4 * c)
        return -(h0 * h0) / total
    pairs = y[0] * y[1] + y[1] * y[2] + y[0] * y[2]
    sums = y[0] + y[1] + y[2]
    ell = sums * -4.0 + pairs * (8 / 3)
    if kernel.order == 6:
        ell = ell - y[0] * y[1] * y[2] * (32 / 15)
    top = 1.0
    if kernel == Kernel.MEHR_4F:
        top = 1.0 - sums / 3
    elif kernel == Kernel.MEHR_6F:
        top = 1.0 - sums / 3 + pairs * (8 / 45) - (y[0] * y[0] + y[1] * y[1] + y[2] * y[2]) / 15
    return (h0 * h0) * top / ell


class GreenFill:
    """A kernel on a grid: ``sample`` at indices before transformation, ``overwrite`` after it."""

    def __init__(self, grid: GridSpec, kernel: Kernel, alpha: float = 2.0):
        self.grid, self.kernel = grid, Kernel(kernel)
        hs = [h for h in grid.h if h]
        if self.kernel != Kernel.CHAT_2 and max(hs) - min(hs) > 1e-12 * max(hs):
            raise ValueError(f"{self.kernel.name} needs the same spacing along all axes")
        if self.kernel == Kernel.HEJ_0 and len(grid.unbounded) == 1:
            raise ValueError("HEJ_0 has no form with one unbounded axis")
        self.eps = hs[0] / math.pi if self.kernel == Kernel.HEJ_0 else alpha * hs[0]
        self.lattice = self.kernel.family in ("LGF", "MEHR")
        self._table: np.ndarray | None = None

    def shape(self) -> tuple[int, int, int]:
        """Points before transformation."""
        g = self.grid
        return tuple(len(green_line(p, g.half(d))) if p.unbounded else g.modes[d] for d, p in enumerate(g.axes))

    def wave(self, axis: int, e):
        """Wave number of mode ``e`` (mirrored beyond the middle of a complex axis)."""
        p = self.grid.axes[axis]
        s = p.symstart(self.grid.half(axis))
        e = np.asarray(e, float)
        if s:
            e = np.where(e > s, e - p.padded, e)
        return (e + p.koffset) * p.kfact

    def offset(self, axis: int, e):
        return np.abs(green_line(self.grid.axes[axis], self.grid.half(axis))[np.asarray(e, int)])

    def sample(self, e0, e1, e2) -> np.ndarray:
        g, kernel, e = self.grid, self.kernel, (e0, e1, e2)
        free = g.unbounded
        bound = [d for d in range(3) if d not in free]
        h = g.h
        if not free:
            k = [self.wave(d, e[d]) for d in range(3)]
            still = (k[0] == 0) & (k[1] == 0) & (k[2] == 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(still, 0.0, spectral(kernel, [np.where(still & (d == 0), 1.0, k[d]) for d in range(3)], self.eps, h))
        n = [self.offset(d, e[d]) for d in free]
        r = np.sqrt(sum((a * h[d]) ** 2 for a, d in zip(n, free)))
        if len(free) == 3:
            if self.lattice:
                return -self._lattice(n) / h[0]
            return unbounded3(kernel, r, self.eps, h)
        k = np.sqrt(sum(self.wave(d, e[d]) ** 2 for d in bound))
        if len(free) == 2:
            if self.lattice:
                return np.where(k == 0, -self._lattice(n), 0.0)
            return unbounded2(kernel, r, k, self.eps, math.sqrt(h[free[0]] * h[free[1]] / math.pi))
        if self.lattice:
            hh = h[free[0]]
            return -hh * S.line(kernel, n[0], self.wave(bound[0], e[bound[0]]) * hh, self.wave(bound[1], e[bound[1]]) * hh)
        return unbounded1(kernel, r, k, self.eps)

    @property
    def table(self) -> np.ndarray:
        """Lattice function at the offsets near the origin; integrated once, and sent along where a fill goes to workers."""
        if self._table is None:
            self._table = (S.table3 if len(self.grid.unbounded) == 3 else S.table2)(self.kernel, self.reach)
        return self._table

    @property
    def reach(self) -> int:
        """Largest offset that the table has to hold."""
        g = self.grid
        return min(max(int(np.abs(green_line(g.axes[d], g.half(d))).max()) for d in g.unbounded), LATTICE_REACH)

    def load(self, table: np.ndarray) -> None:
        """Take a table that was made elsewhere."""
        self._table = table

    def __getstate__(self):
        if self.lattice and len(self.grid.unbounded) > 1:
            self.table  # noqa: B018
        return self.__dict__

    def _lattice(self, n) -> np.ndarray:
        n = np.broadcast_arrays(*n)
        t, m = self.table, LATTICE_REACH
        out = t[tuple(np.minimum(x, len(t) - 1).astype(int) for x in n)]
        beyond = np.max(n, axis=0) > m
        if beyond.any():
            # in the plane the far field lacks a constant: the table's edge has it
            shift = 0.0 if len(n) == 3 else np.mean([t[m, j] - far(self.kernel, float(m), float(j)) for j in range(m + 1)])
            out[beyond] = far(self.kernel, *(x[beyond] for x in n)) + shift
        return out

    @property
    def overwrites(self) -> bool:
        """With two unbounded axes in three dimensions only k = 0 is sampled; other modes take the fully spectral form."""
        g = self.grid
        return len(g.unbounded) == 2 and self.kernel != Kernel.CHAT_2 and all(p.kind != AxisClass.EMPTY for p in g.axes)

    def overwrite(self, e0, e1, e2, green) -> np.ndarray:
        if not self.overwrites:
            return green
        k = [self.wave(d, x) for d, x in enumerate((e0, e1, e2))]
        axis = next(d for d in range(3) if not self.grid.axes[d].unbounded)
        moving = k[axis] != 0
        safe = [np.where(moving, x, 1.0) for x in k]
        return np.where(moving, spectral(self.kernel, safe, self.eps, self.grid.h), green)
