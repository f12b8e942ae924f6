"""One-dimensional transforms of many lines at once, numpy only.

The eight real transforms are written as Fourier transforms of the even or odd extension of a
line; none is normalised.  ``forward`` and ``backward`` place padding, left-out points and
zeroed modes as an ``AxisPlan`` says."""

from __future__ import annotations

import numpy as np

from gridloom.plans.spec import AxisClass, AxisPlan


def _twist(n: int, sign: float, quarter: float = 1.0) -> np.ndarray:
    return np.exp(sign * 1j * np.pi * quarter * np.arange(n) / (2 * n))


def dct1(x):
    if x.shape[-1] == 1:
        return x.copy()
    return np.fft.fft(np.concatenate([x, x[..., -2:0:-1]], -1))[..., : x.shape[-1]].real


def dct2(x):
    n = x.shape[-1]
    y = np.fft.fft(np.concatenate([x, x[..., ::-1]], -1))[..., :n]
    return (y * _twist(n, -1)).real


def dct3(x):
    n = x.shape[-1]
    y = x * _twist(n, 1)
    full = np.concatenate([y, np.zeros_like(y[..., :1]), np.conj(y[..., :0:-1])], -1)
    return (np.fft.ifft(full)[..., :n] * 2 * n).real


def dct4(x):
    n = x.shape[-1]
    z = np.zeros((*x.shape[:-1], 8 * n))
    k = 2 * np.arange(n) + 1
    z[..., k], z[..., 4 * n - k], z[..., 4 * n + k], z[..., 8 * n - k] = x, -x, -x, x
    return np.fft.fft(z)[..., 1 : 2 * n : 2].real / 2


def dst1(x):
    n = x.shape[-1]
    z = np.zeros((*x.shape[:-1], 1))
    return -np.fft.fft(np.concatenate([z, x, z, -x[..., ::-1]], -1))[..., 1 : n + 1].imag


def dst2(x):
    n = x.shape[-1]
    sign = np.where(np.arange(n) % 2, -1.0, 1.0)
    return dct2(x * sign)[..., ::-1]


def dst3(x):
    n = x.shape[-1]
    sign = np.where(np.arange(n) % 2, -1.0, 1.0)
    return dct3(x[..., ::-1]) * sign


def dst4(x):
    n = x.shape[-1]
    sign = np.where(np.arange(n) % 2, -1.0, 1.0)
    return dct4(x[..., ::-1]) * sign


def _real(f, x):
    """A real transform of real or complex lines."""
    return f(x.real) + 1j * f(x.imag) if np.iscomplexobj(x) else f(x)


def _symmetric(plan: AxisPlan):
    """(forward, backward, places) of a real transform; places are (first point in, points, first mode, modes)."""
    even = not plan.odd
    if plan.kind == AxisClass.MIXUNB or plan.left == plan.right:
        n = plan.padded
        if plan.cell:
            return (dct2, dct3, (0, n, 0, n)) if even else (dst2, dst3, (0, n, 1, n))
        return (dct1, dct1, (0, n, 0, n)) if even else (dst1, dst1, (1, n - 2, 1, n - 2))
    n = plan.n
    if plan.cell:
        return (dct4, dct4, (0, n, 0, n)) if even else (dst4, dst4, (0, n, 0, n))
    return (dct3, dct2, (0, n - 1, 0, n - 1)) if even else (dst3, dst2, (1, n - 1, 0, n - 1))


def _turn(n: int, sign: float) -> np.ndarray:
    """Half a step of the circle of n points, for each point."""
    return np.exp(sign * 1j * np.pi * np.arange(n) / n)


def padded_forward(x: np.ndarray, n: int, half: bool) -> np.ndarray:
    """Modes of lines of up to n + 1 points, padded to 2n by zeros that are never stored: modes of even number are those of
    the n points, modes of odd number those of the points turned by half a step; a point n changes sign with them."""
    out = np.empty((*x.shape[:-1], n + 1 if half else 2 * n), complex)
    end = x[..., n:] if x.shape[-1] > n else None
    x = x[..., :n]
    if x.shape[-1] < n:
        x = np.concatenate([x, np.zeros((*x.shape[:-1], n - x.shape[-1]), x.dtype)], -1)
    even, odd = out[..., 0::2], out[..., 1::2]
    even[...] = np.fft.rfft(x)[..., : even.shape[-1]] if half else np.fft.fft(x)
    odd[...] = np.fft.fft(x * _turn(n, -1))[..., : odd.shape[-1]]
    if end is not None:
        even += end
        odd -= end
    return out


def padded_backward(y: np.ndarray, n: int, points: int, half: bool) -> np.ndarray:
    """The first ``points`` (up to n + 1) of the 2n points of lines of modes, not normalised: two transforms of n."""

    def modes(first: int) -> np.ndarray:
        if not half:
            return y[..., first::2]
        q = np.arange(first, 2 * n, 2)
        z = y[..., np.minimum(q, 2 * n - q)]
        return np.conj(z, out=z, where=q > n)  # beyond the half, modes are conjugates

    even, odd = modes(0), modes(1)
    x = np.fft.ifft(even, norm="forward") + np.fft.ifft(odd, norm="forward") * _turn(n, 1)
    if points > n:
        x = np.concatenate([x, even.sum(-1, keepdims=True) - odd.sum(-1, keepdims=True)], -1)
    x = x[..., :points] if points < n else x
    return x.real.copy() if half else x


def forward(plan: AxisPlan, x: np.ndarray, half: bool = False) -> np.ndarray:
    """Lines of user points to lines of modes (last axis)."""
    if plan.kind == AxisClass.EMPTY:
        return x
    if plan.kind == AxisClass.UNBUNB:
        return padded_forward(x, plan.padded // 2, half)
    if plan.complex:
        n = plan.padded
        x = x[..., :n]  # a periodic node line repeats its first point; a shorter one is padded
        return np.fft.rfft(x, n) if half else np.fft.fft(x, n)
    f, _, (p0, pn, m0, mn) = _symmetric(plan)
    line = np.zeros((*x.shape[:-1], max(plan.padded, plan.offset + plan.n)), x.dtype)
    line[..., plan.offset : plan.offset + plan.n] = x
    out = np.zeros((*x.shape[:-1], plan.modes(half)), x.dtype)
    out[..., m0 : m0 + mn] = _real(f, line[..., p0 : p0 + pn])
    return out


def backward(plan: AxisPlan, y: np.ndarray, half: bool = False) -> np.ndarray:
    """Lines of modes to lines of user points, not normalised."""
    if plan.kind == AxisClass.EMPTY:
        return y
    if plan.kind == AxisClass.UNBUNB:
        return padded_backward(y, plan.padded // 2, plan.n, half)
    if plan.complex:
        n = plan.padded
        x = np.fft.irfft(y, n, norm="forward") if half else np.fft.ifft(y, norm="forward")
        if plan.kind == AxisClass.PERPER and not plan.cell:
            return np.concatenate([x, x[..., :1]], -1)
        return x
    _, b, (p0, pn, m0, mn) = _symmetric(plan)
    line = np.zeros((*y.shape[:-1], max(plan.padded, plan.offset + plan.n)), y.dtype)
    line[..., p0 : p0 + pn] = _real(b, y[..., m0 : m0 + mn])
    return line[..., plan.offset : plan.offset + plan.n]


def green_line(plan: AxisPlan, half: bool) -> np.ndarray:
    """Signed distances, in spacings, of the points where a Green's function is sampled along an unbounded axis."""
    if plan.kind == AxisClass.MIXUNB:
        return np.arange(plan.modes(half), dtype=float)
    i = np.arange(plan.padded, dtype=float)
    return np.where(i <= plan.padded // 2, i, i - plan.padded)


def green_forward(plan: AxisPlan, x: np.ndarray, half: bool) -> np.ndarray:
    """Transform of a Green's function along an unbounded axis (its lines are even, so the result is real if x is)."""
    if plan.kind == AxisClass.MIXUNB:
        return _real(dct1, x)
    if np.iscomplexobj(x):
        return np.fft.fft(x)[..., : plan.modes(half)]
    n = x.shape[-1]
    y = np.fft.rfft(x).real
    return y.copy() if plan.modes(half) <= n // 2 + 1 else np.concatenate([y, y[..., 1 : n // 2][..., ::-1]], -1)
