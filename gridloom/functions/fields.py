"""Manufactured fields: a solution and its Laplacian as products of one-axis functions that fit the
boundary conditions.  Each function is written once and serves numpy arrays and Spark columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from gridloom.plans.spec import BC, AxisPlan, GridSpec

#: wave counts along the three axes, and the shape of the compact bump (fixed values)
FREQUENCY = (1, 2, 4)
BUMP = {"c": 10.0, "half_width": 0.5, "middle": 0.5, "near_left": 0.3, "near_right": 0.7}


@dataclass(frozen=True)
class AxisField:
    """f and f'' along one axis as functions of position, for a library with sin, cos, exp, where."""

    plan: AxisPlan
    frequency: int

    def value(self, x, lib):
        return self._wave(x, lib, False)

    def second(self, x, lib):
        return self._wave(x, lib, True)

    def _wave(self, x, lib, second: bool):
        left, right, length = self.plan.left, self.plan.right, self.plan.length
        if BC.NONE in (left, right):
            return x * 0.0 if second else x * 0.0 + 1.0
        if BC.UNB in (left, right):
            return self._bump(x, lib, second)
        k, wave = {
            (BC.PER, BC.PER): (2 * math.pi * self.frequency, lib.sin),
            (BC.ODD, BC.ODD): (2 * math.pi * self.frequency, lib.sin),
            (BC.EVEN, BC.EVEN): (math.pi * self.frequency, lib.cos),
            (BC.ODD, BC.EVEN): (math.pi * (self.frequency + 0.5), lib.sin),
            (BC.EVEN, BC.ODD): (math.pi * (self.frequency + 0.5), lib.cos),
        }[left, right]
        k /= length
        return wave(x * k) * (-k * k if second else 1.0)

    def _bump(self, x, lib, second: bool):
        left, right, length = self.plan.left, self.plan.right, self.plan.length
        at, images = BUMP["middle"], []
        if left == BC.UNB and right != BC.UNB:
            at = BUMP["near_right"]
            images = [(2 - at, 1.0 if right == BC.EVEN else -1.0)]
        elif right == BC.UNB and left != BC.UNB:
            at = BUMP["near_left"]
            images = [(-at, 1.0 if left == BC.EVEN else -1.0)]
        c, width, total = BUMP["c"], BUMP["half_width"] * length, 0.0
        for centre, sign in [(at, 1.0), *images]:
            u = (x - centre * length) / width
            q = u * u
            inside = q < 1.0
            safe = lib.where(inside, q, q * 0.0)
            f = lib.exp((1.0 - 1.0 / (1.0 - safe)) * c) * sign
            if second:
                one = safe - 1.0
                f = f * (2 * c) * (safe * (2 * (c - 1)) + safe * safe * 3.0 - 1.0) / (one * one * one * one) / (width * width)
            total = total + lib.where(inside, f, q * 0.0)
        return total


def gaussian(x, lib, centre: float, sigma: float, second: bool = False):
    """A Gaussian of unit height along one axis, or its second derivative."""
    u = (x - centre) / sigma
    f = lib.exp(u * u * -0.5)
    return f * (u * u - 1.0) / (sigma * sigma) if second else f


def axis_fields(grid: GridSpec, component: int = 0) -> list[AxisField]:
    return [AxisField(grid.plan(d, component), FREQUENCY[d]) for d in range(3)]


def manufactured(grid: GridSpec, x, lib, component: int = 0):
    """(right-hand side, solution) at positions ``x`` (three arrays or Columns)."""
    parts = axis_fields(grid, component)
    f = [p.value(v, lib) for p, v in zip(parts, x)]
    s = [p.second(v, lib) for p, v in zip(parts, x)]
    return s[0] * f[1] * f[2] + f[0] * s[1] * f[2] + f[0] * f[1] * s[2], f[0] * f[1] * f[2]
