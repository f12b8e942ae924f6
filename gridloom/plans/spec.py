"""Problem description: boundary conditions, kernels, grids and the per-axis transform plans.

Pure Python; everything Spark does later is derived from these frozen values."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import IntEnum


class BC(IntEnum):
    """Condition on one side of one axis (fixed values)."""

    EVEN = 0
    ODD = 1
    PER = 3
    UNB = 4
    NONE = 9


class Kernel(IntEnum):
    """Green's functions (fixed values)."""

    CHAT_2 = 0
    LGF_2 = 1
    HEJ_2 = 2
    HEJ_4 = 3
    HEJ_6 = 4
    HEJ_8 = 5
    HEJ_10 = 6
    HEJ_0 = 7
    LGF_4 = 8
    LGF_6 = 9
    LGF_8 = 10
    MEHR_4L = 11
    MEHR_6L = 12
    MEHR_4F = 13
    MEHR_6F = 14

    @property
    def family(self) -> str:
        return self.name.split("_")[0]

    @property
    def order(self) -> int:
        return int(self.name.split("_")[1].rstrip("LF"))


class Equation(IntEnum):
    STD = 0
    ROT = 1


class Diff(IntEnum):
    """Derivative used by the rotational equation."""

    NOD = 0
    SPE = 1
    FD2 = 2
    FD4 = 4
    FD6 = 6


class Center(IntEnum):
    NODE = 0
    CELL = 1


class AxisClass(IntEnum):
    """Transform family of an axis; the value is its place in the order of execution."""

    SYMSYM = 2
    MIXUNB = 5
    PERPER = 6
    UNBUNB = 8
    EMPTY = 18


def classify(left: BC, right: BC) -> AxisClass:
    """Family of a pair of sides; raises for pairs that no transform serves."""
    pair = {left, right}
    if pair <= {BC.EVEN, BC.ODD}:
        return AxisClass.SYMSYM
    if BC.UNB in pair and pair & {BC.EVEN, BC.ODD}:
        return AxisClass.MIXUNB
    for same, kind in ((BC.PER, AxisClass.PERPER), (BC.UNB, AxisClass.UNBUNB), (BC.NONE, AxisClass.EMPTY)):
        if pair == {same}:
            return kind
    raise ValueError(f"no transform for sides {left.name}, {right.name}")


def flipped(bc: BC) -> BC:
    """Condition of the derivative."""
    return {BC.EVEN: BC.ODD, BC.ODD: BC.EVEN}.get(bc, bc)


@dataclass(frozen=True)
class AxisPlan:
    """One axis of one component: sizes, transforms and wave numbers."""

    left: BC
    right: BC
    center: Center
    n: int  # user points
    length: float

    @property
    def kind(self) -> AxisClass:
        return classify(self.left, self.right)

    @property
    def cell(self) -> bool:
        return self.center == Center.CELL

    @property
    def intervals(self) -> int:
        return 1 if self.kind == AxisClass.EMPTY else self.n if self.cell else self.n - 1

    @property
    def h(self) -> float:
        return self.length / self.intervals

    @property
    def spectral(self) -> bool:
        """The Green's function is known in wave space along this axis."""
        return self.kind in (AxisClass.SYMSYM, AxisClass.PERPER)

    @property
    def unbounded(self) -> bool:
        return self.kind in (AxisClass.MIXUNB, AxisClass.UNBUNB)

    @property
    def complex(self) -> bool:
        return self.kind in (AxisClass.PERPER, AxisClass.UNBUNB)

    @property
    def padded(self) -> int:
        """Points given to the transform, before any are left out."""
        if self.unbounded:
            return 2 * self.n if self.cell else 2 * self.n - 1 if self.kind == AxisClass.MIXUNB else 2 * (self.n - 1)
        if self.kind == AxisClass.PERPER:
            return self.n if self.cell else self.n - 1
        return self.n

    @property
    def offset(self) -> int:
        """Where the user points start in the padded line."""
        if self.kind == AxisClass.MIXUNB and self.left == BC.UNB:
            return self.n if self.cell else self.n - 1
        return 0

    def modes(self, half: bool) -> int:
        """Spectral points; ``half`` for the axis that turns real data complex."""
        if self.kind == AxisClass.EMPTY:
            return 1
        if self.complex:
            return self.padded // 2 + 1 if half else self.padded
        if self.kind == AxisClass.MIXUNB:
            return self.padded + 1 if self.cell else self.padded
        return self.n + 1 if self.cell and self.left == self.right else self.n

    @property
    def odd(self) -> bool:
        """The transform is a sine transform."""
        if self.kind == AxisClass.SYMSYM:
            return self.left == BC.ODD
        return self.kind == AxisClass.MIXUNB and BC.ODD in (self.left, self.right)

    @property
    def kfact(self) -> float:
        per = {AxisClass.SYMSYM: 2, AxisClass.MIXUNB: 4, AxisClass.PERPER: 1, AxisClass.UNBUNB: 2, AxisClass.EMPTY: 0}[self.kind]
        return 2 * math.pi / (per * self.length) if per else 0.0

    @property
    def koffset(self) -> float:
        return 0.5 if self.kind == AxisClass.SYMSYM and self.left != self.right else 0.0

    def symstart(self, half: bool) -> int:
        """Index beyond which wave numbers mirror; 0 for none."""
        return self.padded // 2 if self.complex and not half else 0

    @property
    def normfact(self) -> float:
        if self.kind == AxisClass.EMPTY:
            return 1.0
        if self.complex:
            return 1.0 / self.padded
        points = self.intervals * (2 if self.kind == AxisClass.MIXUNB else 1)
        return 1.0 / (2 * points)

    @property
    def volfact(self) -> float:
        return self.h if self.unbounded else 1.0

    def derived(self) -> AxisPlan:
        return AxisPlan(flipped(self.left), flipped(self.right), self.center, self.n, self.length)


def sym_id(e: int, symstart: float, signed: bool = True) -> int:
    """Mirrored index: beyond ``symstart`` the distance to the far end, negative if ``signed``."""
    if symstart == 0 or e <= symstart:
        return e
    back = max(int(abs(2 * symstart - e)), 1)
    return -back if signed else back


@dataclass(frozen=True)
class GridSpec:
    """Grid, boundary conditions and centring of a field.

    ``n`` counts intervals along each axis; ``bc`` is three (left, right) pairs, or one such triple per
    component.  An axis of NONE sides has a single point (two-dimensional problems use the last axis)."""

    n: tuple[int, int, int]
    bc: tuple
    length: tuple[float, float, float] = (1.0, 1.0, 1.0)
    center: Center = Center.CELL
    components: int = 1
    _plans: tuple = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        triples = self.bc if isinstance(self.bc[0][0], (tuple, list)) else (self.bc,) * self.components
        if len(triples) != self.components:
            raise ValueError("one triple of sides for each component is needed")
        plans = []
        for triple in triples:
            row = []
            for d, (left, right) in enumerate(triple):
                left, right = BC(left), BC(right)
                empty = classify(left, right) == AxisClass.EMPTY
                points = 1 if empty else self.n[d] if self.center == Center.CELL else self.n[d] + 1
                row.append(AxisPlan(left, right, Center(self.center), points, float(self.length[d])))
            plans.append(tuple(row))
        for row in plans[1:]:
            for a, b in zip(plans[0], row):
                if a.kind != b.kind or a.koffset != b.koffset:
                    raise ValueError("all components must share the transform family of each axis")
        if any(p.kind == AxisClass.EMPTY for p in plans[0][:2]):
            raise ValueError("only the last axis can be without sides")
        object.__setattr__(self, "_plans", tuple(plans))

    @classmethod
    def of(cls, code: str, n, center: Center = Center.CELL, length=(1.0, 1.0, 1.0), components: int = 1) -> GridSpec:
        """From six digits, left and right of each axis."""
        n = (n, n, n) if isinstance(n, int) else tuple(n)
        sides = [BC(int(c)) for c in code]
        return cls(n, tuple((sides[2 * d], sides[2 * d + 1]) for d in range(3)), tuple(length), center, components)

    def plan(self, axis: int, component: int = 0) -> AxisPlan:
        return self._plans[component][axis]

    @property
    def axes(self) -> tuple[AxisPlan, AxisPlan, AxisPlan]:
        return self._plans[0]

    @property
    def shape(self) -> tuple[int, int, int]:
        return tuple(p.n for p in self.axes)

    @property
    def h(self) -> tuple[float, float, float]:
        return tuple(0.0 if p.kind == AxisClass.EMPTY else p.h for p in self.axes)

    @property
    def volume(self) -> float:
        """Measure of a point: product of the spacings of the axes that have any."""
        return math.prod(p.h for p in self.axes if p.kind != AxisClass.EMPTY)

    @property
    def order(self) -> tuple[int, int, int]:
        """Axes in order of transformation: cheap real ones first, padded complex ones last."""
        return tuple(sorted(range(3), key=lambda d: (self.axes[d].kind, d)))

    @property
    def half_axis(self) -> int | None:
        """The axis whose transform turns the data complex."""
        return next((d for d in self.order if self.axes[d].complex), None)

    def half(self, axis: int) -> bool:
        return axis == self.half_axis

    @property
    def modes(self) -> tuple[int, int, int]:
        return tuple(p.modes(self.half(d)) for d, p in enumerate(self.axes))

    @property
    def unbounded(self) -> tuple[int, ...]:
        return tuple(d for d in range(3) if self.axes[d].unbounded)

    @property
    def normfact(self) -> float:
        return math.prod(p.normfact for p in self.axes)

    @property
    def volfact(self) -> float:
        return math.prod(p.volfact for p in self.axes)

    def spectral_info(self) -> dict[str, tuple]:
        return {
            "kfact": tuple(p.kfact for p in self.axes),
            "koffset": tuple(p.koffset for p in self.axes),
            "symstart": tuple(p.symstart(self.half(d)) for d, p in enumerate(self.axes)),
        }
