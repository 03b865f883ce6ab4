"""Column functions on grid keys.

A box is (level, ix, iy, iz), as many keys as there are dimensions. Its parent is a
right shift, its width the root's width over 2^level.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

AXES = ("x", "y", "z")
#: Deepest level; keys of 60 bits, and their shifts and neighbours, are exact in 64.
TOP = 60


def axes(d: int) -> list[str]:
    return list(AXES[:d])


def key_names(d: int) -> list[str]:
    return [f"i{a}" for a in AXES[:d]]


def box_names(d: int) -> list[str]:
    return ["level", *key_names(d)]


def power2(level: Column | int) -> Column:
    return F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)


def cell_number(x: Column, lo: float, hi: float, level: int) -> Column:
    """The cell of x at a level of the box from lo to hi, where cells go on beyond the box."""
    return F.floor((x - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * F.lit(float(1 << level))).cast("long")


def grid_key(x: Column, lo: float, hi: float, level: int) -> Column:
    """The cell of x at a level of the root box from lo to hi; a point on the upper face is in the last cell."""
    cell = cell_number(x, lo, hi, level)
    return F.greatest(F.least(cell, F.lit((1 << level) - 1)), F.lit(0)).cast("long")


def shift(key: Column, by: Column | int) -> Column:
    """The key, by levels up; by is not negative."""
    return F.call_function("shiftright", key, (F.lit(by) if isinstance(by, int) else by).cast("int"))


def raised(key: Column, by: Column | int) -> Column:
    """The first key that lies by levels below key."""
    return F.call_function("shiftleft", key, (F.lit(by) if isinstance(by, int) else by).cast("int"))


def levels(first: Column | int, last: Column) -> Column:
    """The levels first to last as an array, empty if last is less."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def path(level: Column, keys: list[Column]) -> Column:
    """The digits of the way from the root to a box, the first axis being the most significant bit of each."""
    d = len(keys)
    digit = lambda up: sum(((shift(k, up).bitwiseAND(F.lit(1))) * F.lit(1 << (d - 1 - i)) for i, k in enumerate(keys)), F.lit(0))
    return F.array_join(F.transform(levels(1, level), lambda at: digit(level - at).cast("string")), "")


def offsets(d: int, n: int, zero: bool = False) -> list[tuple[int, ...]]:
    """All moves of up to n cells on each axis, with or without none at all."""
    return [o for o in product(range(-n, n + 1), repeat=d) if zero or any(o)]


def block(names: list[str], first: list[Column], last: list[Column]) -> Column:
    """An array of all keys from first to last on every axis, as structs of the same names."""

    def along(axis: int, chosen: list[Column]) -> Column:
        if axis == len(names):
            return F.array(F.struct(*[c.alias(k) for c, k in zip(chosen, names)]))
        return F.flatten(F.transform(F.sequence(first[axis], last[axis]), lambda v: along(axis + 1, [*chosen, v])))

    return along(0, [])


def moved(names: list[str], n: int, zero: bool = False) -> Column:
    """An array of the keys at all offsets, as structs of the same names."""
    if (2 * n + 1) ** len(names) > 30:  # too much code to write out
        keys = [F.col(k) for k in names]
        around = block(names, [k - n for k in keys], [k + n for k in keys])
        if zero:
            return around
        return F.filter(around, lambda c: ~F.forall(F.array(*[c[k] == F.col(k) for k in names]), lambda same: same))
    return F.array(*[F.struct(*[(F.col(k) + o).alias(k) for k, o in zip(names, move)]) for move in offsets(len(names), n, zero)])


def children(names: list[str]) -> Column:
    """An array of the keys of a box's children, as structs of the same names."""
    return F.array(*[F.struct(*[(F.col(k) * 2 + o).alias(k) for k, o in zip(names, bits)]) for bits in product((0, 1), repeat=len(names))])


def inside(names: list[str], level: Column) -> Column:
    """Whether keys are within the root box."""
    end = raised(F.lit(1).cast("long"), level)
    out = F.lit(True)
    for k in names:
        out &= (F.col(k) >= 0) & (F.col(k) < end)
    return out


def gap(level_a: Column, keys_a: list[Column], level_b: Column, keys_b: list[Column]) -> Column:
    """Cells of the finer box's level, less one, between two boxes; 0 if they touch or overlap by less than a cell.

    It is max over the axes of (larger low - smaller high) at the finer level.
    """
    fine = F.greatest(level_a, level_b)
    up_a, up_b = fine - level_a, fine - level_b
    return F.greatest(*[F.greatest(raised(a, up_a), raised(b, up_b)) - F.least(raised(a + 1, up_a), raised(b + 1, up_b)) for a, b in zip(keys_a, keys_b)], *([F.lit(-(1 << 62))] * (len(keys_a) == 1)))


def within(level_t: Column, keys_t: list[Column], level_s: Column, keys_s: list[Column], n: int) -> Column:
    """Whether box s is within n - 1 widths of t of box t; n = 1 is touching."""
    room = (n - 1) * raised(F.lit(1).cast("long"), F.greatest(level_t, level_s) - level_t)
    return gap(level_t, keys_t, level_s, keys_s) <= room
