"""Special functions on numpy arrays: error function, exponential and sine integrals, modified
Bessel functions, and the lattice Green's functions of one axis with their 2-D and 3-D tables."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from gridloom.plans.spec import Kernel

GAMMA = 0.57721566490153286061


def erf(x):
    """Error function: a series of positive terms near the origin, a continued fraction of the complement beyond 3."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 27.0)
    out = np.empty_like(a)
    near = a <= 3.0
    t = a[near]
    term = total = 2 / math.sqrt(math.pi) * t * np.exp(-t * t)
    for k in range(1, 90):
        term = term * (2 * t * t) / (2 * k + 1)
        total = total + term
    out[near] = total
    t = a[~near]
    f = np.zeros_like(t)
    for k in range(60, 0, -1):
        f = (k / 2) / (t + f)
    out[~near] = 1 - np.exp(-t * t) / (math.sqrt(math.pi) * (t + f))
    return np.copysign(out, x)


def _cf_e1(z):
    """exp(z) * E1(z) by Lentz's continued fraction, for |z| away from 0."""
    z = np.asarray(z)
    b = z + 1.0
    c = np.full_like(b, 1e300)
    d = 1.0 / b
    h = d.copy()
    for i in range(1, 400):
        a = -float(i * i)
        b = b + 2.0
        d = 1.0 / (a * d + b)
        c = b + a / c
        step = c * d
        h = h * step
        if np.all(np.abs(step - 1) < 1e-16):
            break
    return h


def e1(x):
    """Exponential integral E1 for x > 0."""
    x = np.asarray(x, float)
    out = np.empty_like(x)
    small = x <= 2.0
    t = x[small]
    total, term = np.zeros_like(t), np.ones_like(t)
    for k in range(1, 60):
        term = term * (-t) / k
        total -= term / k
    out[small] = total - GAMMA - np.log(np.where(t > 0, t, 1.0))
    big = x[~small]
    out[~small] = np.exp(-big) * _cf_e1(big)
    return out


def en(n: int, x):
    """Exponential integral E_n for x > 0, n >= 1, by upward recurrence from E1."""
    x = np.asarray(x, float)
    out = e1(x)
    for k in range(1, n):
        out = (np.exp(-x) - x * out) / k
    return out


def bessel_i(order: int, x):
    """I0 or I1: mean of exp(x cos t) cos(order t) over a half circle, which converges geometrically."""
    x = np.asarray(x, float)
    n = 64 + int(2 * np.max(np.abs(x), initial=0.0))
    t = (np.arange(n) + 0.5) * math.pi / n
    return np.mean([np.exp(x * math.cos(a)) * math.cos(order * a) for a in t], axis=0)


def _cisi(x):
    """(Cin, Si): integrals of (1 - cos t)/t and sin t / t from 0 to x >= 0."""
    x = np.asarray(x, float)
    cin, si = np.zeros_like(x), np.zeros_like(x)
    small = x <= 4.0
    t = x[small]
    term, c, s = np.ones_like(t), np.zeros_like(t), np.zeros_like(t)
    for k in range(1, 60):  # t^k / k!
        term = term * t / k
        if k % 2:
            s += (1 if k % 4 == 1 else -1) * term / k
        else:
            c += (1 if k % 4 == 2 else -1) * term / k
    cin[small], si[small] = c, s
    big = x[~small]
    if len(big):
        f = np.exp(-1j * big) * _cf_e1(1j * big)
        cin[~small] = GAMMA + np.log(big) + f.real
        si[~small] = math.pi / 2 + f.imag
    return cin, si


def si(x):
    """Sine integral, x >= 0."""
    return _cisi(x)[1]


def ji0c(x):
    """Integral of (1 - J0(t)) / t from 0 to x >= 0, as a mean of Cin over a quarter circle."""
    own, back = np.unique(np.asarray(x, float), return_inverse=True)
    n = 128
    angle = (np.arange(n) + 0.5) * math.pi / (2 * n)
    return np.mean([_cisi(own * math.sin(a))[0] for a in angle], axis=0)[back].reshape(np.shape(x))


def bessel_k(order: int, x):
    """K0 or K1 for x > 0: trapezoidal sum of exp(-x cosh t) cosh(order t), which converges geometrically."""
    x = np.asarray(x, float)
    step = 1 / 16
    out = np.zeros_like(x)
    for j in range(int(40 / step)):
        t = j * step
        e = x * math.cosh(t)
        if np.all(e > 800):
            break
        out += np.exp(-e) * math.cosh(order * t) * (0.5 if j == 0 else 1.0)
    return out * step


#: coefficients of 2 - 2 cos(m k), m = 1, 2, ..., in the symbol of the second derivative, by order (fixed values)
SECOND = {2: (1.0,), 4: (4 / 3, -1 / 12), 6: (3 / 2, -3 / 20, 1 / 90), 8: (8 / 5, -1 / 5, 8 / 315, -1 / 560)}
#: 2 cos(m k) - 2 as a polynomial in delta = 2 cos(k) - 2, lowest power first
_POWERS = {1: (0, 1), 2: (0, 4, 1), 3: (0, 9, 6, 1), 4: (0, 16, 20, 8, 1)}


def symbol(order: int, k):
    """Symbol of minus the second difference, at the scaled wave number k h."""
    return sum(4 * c * np.sin(m * np.asarray(k, float) / 2) ** 2 for m, c in enumerate(SECOND[order], 1))


def lattice_line(order: int, n, c):
    """g(n, c): Green's function of ``symbol + c`` on a line; for c = 0 the part that stays finite (-|n|/2 and decaying terms).

    Partial fractions in delta: each root contributes r^|n| / ((r - 1/r) P'(delta))."""
    n, c = np.broadcast_arrays(np.abs(np.asarray(n, float)), np.asarray(c, float))
    own, back = np.unique(c, return_inverse=True)
    w = len(SECOND[order])
    poly = np.zeros(w + 1)
    for m, q in enumerate(SECOND[order], 1):
        poly[: m + 1] -= q * np.asarray(_POWERS[m], float)
    if w == 1:
        delta = own[:, None].astype(complex)
    else:
        comp = np.zeros((len(own), w, w))
        comp[:, np.arange(1, w), np.arange(w - 1)] = 1
        comp[:, :, -1] = -poly[:-1] / poly[-1]
        comp[:, 0, -1] = -own / poly[-1]
        delta = np.linalg.eigvals(comp).astype(complex)
        for _ in range(3):  # Newton steps restore the relative accuracy of small roots
            value = own[:, None] + np.polyval(poly[::-1], delta)
            slope = np.polyval(np.polyder(poly[::-1]), delta)
            delta = delta - np.where(np.abs(slope) > 1e-8, value / np.where(slope == 0, 1, slope), 0)
    slope = np.polyval(np.polyder(poly[::-1]), delta) if w > 1 else np.full(delta.shape, poly[1], complex)
    s = np.sqrt(delta + delta**2 / 4)
    inverse = 1 + delta / 2 + s
    swap = np.abs(inverse) < 1
    inverse, s = np.where(swap, 1 + delta / 2 - s, inverse), np.where(swap, -s, s)
    zero = (own == 0)[:, None] & (np.abs(delta) < 1e-8)
    weight = np.where(zero, 0, 1 / np.where(zero, 1, -2 * s * slope))
    out = np.zeros(n.shape)
    for j in range(delta.shape[1]):
        out += (weight[back, j].reshape(n.shape) * inverse[back, j].reshape(n.shape) ** (-n)).real
    return out - np.where(own[back].reshape(n.shape) == 0, n / 2, 0)


def mehrstellen_line(kernel: Kernel, n, y0, y1):
    """Green's function of the compact stencil on a line, at y = sin^2(k h / 2) of the other axes."""
    n, y0, y1 = np.broadcast_arrays(np.abs(np.asarray(n, float)), np.asarray(y0, float), np.asarray(y1, float))
    cross = 0.0 if kernel.order == 4 else -8 / 15 * y0 * y1
    a1 = 2 / 3 * (y0 + y1) - 1 + cross
    a0 = 2 + 8 / 3 * (y0 + y1) - (8 / 3 if kernel.order == 4 else 8 / 5) * y0 * y1
    flat = np.abs(a1) < 1e-13
    rest = 4 * (y0 + y1) - 8 / 3 * y0 * y1  # a0 + 2 a1, without its cancellation
    delta = np.where(flat, 1.0, -rest / np.where(flat, 1.0, a1))  # 2 cos k - 2 at the pole
    s = np.sqrt((delta + delta**2 / 4).astype(complex))
    inverse = 1 + delta / 2 + s
    swap = np.abs(inverse) < 1
    inverse, s = np.where(swap, 1 + delta / 2 - s, inverse), np.where(swap, -s, s)
    still = (y0 == 0) & (y1 == 0)

    def left(m):
        m = np.abs(m)
        with np.errstate(over="ignore"):  # a power that vanishes overflows on its way
            some = (inverse ** (-m) / np.where(still | flat, 1, -2 * s * a1)).real
        return np.where(still, -m / 2, np.where(flat, np.where(m == 0, 1 / a0, 0.0), some))

    if kernel.name.endswith("L"):
        return left(n)
    if kernel.order == 4:
        b = (5 / 6 - (y0 + y1) / 3, 1 / 12 + 0 * y0, 0 * y0)
    else:
        b = (97 / 120 - 11 / 45 * (y0 + y1) + 8 / 45 * y0 * y1 - (y0**2 + y1**2) / 15, 1 / 10 - 2 / 45 * (y0 + y1), -1 / 240 + 0 * y0)
    return b[0] * left(n) + b[1] * (left(n - 1) + left(n + 1)) + b[2] * (left(n - 2) + left(n + 2))


def line(kernel: Kernel, n, k0, k1):
    """One-axis lattice Green's function at scaled wave numbers of the other two axes."""
    if kernel.family == "LGF":
        return lattice_line(kernel.order, n, symbol(kernel.order, k0) + symbol(kernel.order, k1))
    return mehrstellen_line(kernel, n, np.sin(np.asarray(k0) / 2) ** 2, np.sin(np.asarray(k1) / 2) ** 2)


def node_count(m: int) -> int:
    """Quadrature nodes for offsets up to ``m``."""
    return 100 + 4 * m


@lru_cache(maxsize=8)
def _nodes(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss nodes on (0, pi), graded towards 0 as the fifth power."""
    t, w = np.polynomial.legendre.leggauss(node_count(m))
    t, w = (t + 1) / 2, w / 2
    return math.pi * t**5, 5 * math.pi * t**4 * w


def partial_plane(kernel: Kernel, axes: int, m: int, n: int, part: slice = slice(None)) -> np.ndarray:
    """What the nodes ``part`` of one axis give to the table at offset ``n`` of the last axis and 0..m of the others: an
    inverse transform over all axes but that one of the one-axis function.  In the plane the table is 0 at the origin."""
    k, w = _nodes(m)
    c = np.cos(np.arange(m + 1)[:, None] * k)
    if axes == 3:
        c = c * w / math.pi
        k0, k1 = np.meshgrid(k[part], k, indexing="ij")
        return c[:, part] @ line(kernel, float(n), k0, k1) @ c.T
    k = k[part]
    return ((c[:, part] * line(kernel, float(n), k, 0.0) - line(kernel, 0.0, k, 0.0)) * w[part]).sum(-1) / math.pi


@lru_cache(maxsize=32)
def table3(kernel: Kernel, m: int) -> np.ndarray:
    """T[n0, n1, n2] for offsets 0..m of an unbounded lattice."""
    return np.stack([partial_plane(kernel, 3, m, n) for n in range(m + 1)], -1)


@lru_cache(maxsize=32)
def table2(kernel: Kernel, m: int) -> np.ndarray:
    """T[n0, n1] for offsets 0..m of an unbounded plane, 0 at the origin."""
    return np.stack([partial_plane(kernel, 2, m, n) for n in range(m + 1)], -1)
