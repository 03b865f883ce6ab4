"""Trees of boxes over points: adaptive, non-adaptive and level-restricted.

A box splits if the weight of its points that may descend exceeds the limit. This has
a closed form: weights shrink downwards, so the boxes that split are the cells over
the limit, and a point's box is one below the last such cell on its way. Cells are
counted several levels at a time: points are grouped once by their cell at the last
of these levels, and the counts of the levels above come from those groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from quadrille.functions.keys import TOP, axes, box_names, cell_number, children, grid_key, inside, key_names, levels, moved, path, power2, raised, shift
from quadrille.functions.ordering import numbered, running
from quadrille.plans.shared import cut

KINDS = ("adaptive", "non-adaptive", "adaptive-level-restricted")
NORMS = ("linf", "l2")
#: The root box is this much larger than the points' range.
ROOT_EXTENT_STRETCH = 1e-4


#: A coordinate's significant bits, by type: a tree has less than twice as many levels, and not more than keys have bits.
SIGNIFICANT = {"float": 24, "double": 53}


class MaxLevelsExceeded(RuntimeError):
    """A box at the deepest level still holds more than the limit."""


def deepest_level(particles: DataFrame, d: int) -> int:
    """The deepest level that a tree over these points may have, by the type of their coordinates: all axes have
    the same, float or double; whole numbers count as double."""
    kinds = {particles.schema[a].dataType for a in axes(d)}
    if not all(isinstance(k, NumericType) for k in kinds):
        raise TypeError("coordinates must be numbers")
    if len(kinds) > 1:
        raise TypeError("coordinates must have the same type on all axes")
    return min(2 * SIGNIFICANT.get(kinds.pop().typeName(), SIGNIFICANT["double"]) - 2, TOP)


@dataclass(frozen=True)
class Tree:
    """boxes: level, keys, n_own, n_src_own, n_tgt_own, n_cumul, n_src_cumul, n_tgt_cumul, is_split.
    particles: those given, with role and radius, the level and keys of their box."""

    d: int
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    boxes: DataFrame
    particles: DataFrame
    split: DataFrame
    stick_out: float = 0.0
    norm: str = "linf"
    has_extent: bool = False

    @property
    def width(self) -> float:
        return self.hi[0] - self.lo[0]

    def radius(self, level: Column) -> Column:
        """Half the width of a box at a level."""
        return F.lit(self.width) / power2(level) / 2

    def center(self, axis: int, level: Column, key: Column) -> Column:
        return F.lit(self.lo[axis]) + (key + 0.5) * (F.lit(self.width) / power2(level))

    def leaves(self) -> DataFrame:
        return self.boxes.where(~F.col("is_split"))


def bounding_box(particles: DataFrame, d: int) -> tuple[list[float], list[float]]:
    """Least and greatest coordinates of points with their radius."""
    r = F.col("radius") if "radius" in particles.columns else F.lit(0.0)
    row = particles.agg(*[f(F.col(a) - s * r) for a in axes(d) for f, s in ((F.min, 1), (F.max, -1))]).first()
    if row[0] is None:
        raise ValueError("there are no points")
    return list(row[0::2]), list(row[1::2])


def root_box_row(particles: DataFrame, d: int) -> DataFrame:
    """The root box as a table of one row: lo_x, .., hi_x, .. All null if there are no points."""
    r = F.col("radius") if "radius" in particles.columns else F.lit(0.0)
    found = particles.agg(*[f(F.col(a) - s * r).alias(f"{n}_{a}") for a in axes(d) for n, f, s in (("lo", F.min, 1), ("_hi", F.max, -1))])
    extent = F.greatest(*[F.col(f"_hi_{a}") - F.col(f"lo_{a}") for a in axes(d)], F.lit(0.0)) * (1 + ROOT_EXTENT_STRETCH)
    return found.select(*[f"lo_{a}" for a in axes(d)], *[(F.col(f"lo_{a}") + extent).alias(f"hi_{a}") for a in axes(d)])


def root_box(low: list[float], high: list[float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """A cube from the low corner on, a little larger than the largest range."""
    extent = max(h - l for l, h in zip(low, high)) * (1 + ROOT_EXTENT_STRETCH)
    return tuple(low), tuple(l + extent for l in low)


def checked_box(bbox, low: list[float], high: list[float], beyond: bool = False) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """A bounding box that the user gives, as (low, high) pairs: it must be a cube and, but for beyond, hold all points."""
    lo, hi = tuple(float(b[0]) for b in bbox), tuple(float(b[1]) for b in bbox)
    if max(h - l for l, h in zip(lo, hi)) - min(h - l for l, h in zip(lo, hi)) > 1e-15:
        raise ValueError("the bounding box must have the same width on all axes")
    if not beyond and any(a < l or b > h for a, b, l, h in zip(low, high, lo, hi)):
        raise ValueError("the bounding box must hold all points")
    return lo, hi


def _tiles(lo, hi, low: list[float], high: list[float]) -> tuple[int, list[int]]:
    """How many levels above the box from lo to hi a cube of such boxes holds all points, and the box's keys in that cube."""
    cells = [(math.floor((a - l) / (h - l)), math.floor((b - l) / (h - l))) for a, b, l, h in zip(low, high, lo, hi)]
    first = [min(a, 0) for a, _ in cells]
    across = max(max(b, 0) - f + 1 for f, (_, b) in zip(first, cells))
    above = (across - 1).bit_length()
    if above >= TOP:
        raise ValueError("points are too far from the bounding box")
    return above, [-f for f in first]


def _descends(d: int, lo, hi, stick_out: float, norm: str) -> Column:
    """The deepest level whose box, enlarged by the stick-out factor, holds the point with its radius."""
    width, r = hi[0] - lo[0], F.col("radius")

    def fits(level: Column) -> Column:
        half = F.lit(width) / power2(level) / 2
        room = (1 + stick_out) * half
        centers = [F.lit(lo[i]) + (shift(F.col(f"_k{a}"), TOP - level) + 0.5) * (2 * half) for i, a in enumerate(axes(d))]
        if norm == "l2":
            apart = F.sqrt(sum(((F.col(a) - c) ** 2 for a, c in zip(axes(d), centers)), F.lit(0.0)))
            return (apart + r) ** 2 < d * room * room
        out = F.lit(True)
        for a, c in zip(axes(d), centers):
            out &= (F.col(a) + r < c + room) & (F.col(a) - r >= c - room)
        return out

    # Where a box's room is less than the radius, no point with it fits.
    last = F.least(F.floor(F.log2(F.lit((1 + stick_out) * width) / r)), F.lit(TOP))
    return F.when(r == 0, TOP + 1).otherwise(F.size(F.filter(levels(1, last), fits)))


def _raised_cells(groups: DataFrame, d: int, first: int, amount: Column) -> DataFrame:
    """Sums of amount for every cell at level first and below that the groups (_m, keys at _m) are in."""
    at = groups.select("*", F.explode(levels(first, F.col("_m"))).alias("level"))
    up = F.col("_m") - F.col("level")
    return at.groupBy("level", *[shift(F.col(k), up).alias(k) for k in key_names(d)]).agg(F.sum(amount).alias("w"))


def _split_cells(points: DataFrame, d: int, limit: int, levels_at_once: int, deepest_allowed: int, reached: bool = False) -> tuple[DataFrame, int]:
    """The cells (level, keys) over the limit, and the deepest level with one (-1 if there is none): by the
    weight of points that may descend, or, if reached is set, of all that reach them."""
    names, first, active, found, lowest = key_names(d), 0, points, [], -1
    while True:
        last = min(first + levels_at_once - 1, deepest_allowed)
        m = F.least(F.col("_desc"), F.lit(last)).cast("int")
        keyed = active.select(m.alias("_m"), *[shift(F.col(f"_k{a}"), TOP - m).alias(k) for a, k in zip(axes(d), names)], "weight", "_desc")
        groups = cut(keyed.groupBy("_m", *names).agg(F.sum("weight").alias("_w"), F.sum(F.when(F.col("_desc") > last, F.col("weight")).otherwise(0)).alias("_on")))
        amount = F.col("_w") if reached else F.when(F.col("level") < F.col("_m"), F.col("_w")).when(F.col("level") == last, F.col("_on")).otherwise(0)
        over = cut(_raised_cells(groups, d, first, amount).where(F.col("w") > limit).select("level", *names))
        found.append(over)
        deepest = over.agg(F.max("level")).first()[0]
        lowest = lowest if deepest is None else deepest
        if deepest is None or deepest < last:
            break
        if last == deepest_allowed:
            raise MaxLevelsExceeded(f"a box at level {last} holds more than {limit}: the points in it cannot be told apart by their coordinates")
        here = over.where(F.col("level") == last)
        on = [shift(F.col(f"_k{a}"), TOP - last) == F.col(k) for a, k in zip(axes(d), names)]
        active, first = active.where(F.col("_desc") > last).join(here, on, "left_semi"), last + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, lowest


def _splits_above(cells: DataFrame, split: DataFrame, d: int, depth: int) -> DataFrame:
    """The cells, by their keys at level depth, with how many boxes split above them (_deep).

    They are looked up by blocks of levels, from the root on: cells that share the cell they are in at the
    last level of a block are one row there. So at most 2^16 rows meet at a key, however many points are below it.
    """
    names, at_once, out, first = key_names(d), 16 // d, None, 0
    own = [f"_{k}" for k in names]
    if depth > at_once:
        cells = cut(cells)
    for end in [*range(at_once, depth, at_once), depth]:
        here = cells.select(*[shift(F.col(k), depth - end).alias(o) for k, o in zip(names, own)]).distinct()
        probes = here.select(*own, F.explode(levels(first, F.lit(end - 1))).alias("level"))
        probes = probes.select("*", *[shift(F.col(o), F.lit(end) - F.col("level")).alias(k) for k, o in zip(names, own)])
        found = probes.join(split.withColumn("_one", F.lit(1)), box_names(d), "left").groupBy(*own).agg(F.count("_one").alias("_deep"))
        found = found.select(*[F.col(o).alias(k) for k, o in zip(names, own)], "_deep")
        if out is not None:
            before = out.select(*[F.col(k).alias(o) for k, o in zip(names, own)], F.col("_deep").alias("_before"))
            found = found.select("*", *[shift(F.col(k), end - first).alias(o) for k, o in zip(names, own)]).join(before, own)
            found = found.select(*names, (F.col("_deep") + F.col("_before")).alias("_deep"))
        out, first = found, end
    return out


def restricted(split: DataFrame, d: int, deepest: int) -> DataFrame:
    """split with the boxes that must split too for leaves that touch to differ by one level at most.

    For a box that splits, all its neighbours must exist, so their parents split;
    one join-free pass a level, from the deepest up.
    """
    names = key_names(d)
    if deepest < 1:
        return split
    out, now = None, split.where(F.col("level") == deepest)
    for level in range(deepest, 0, -1):
        out = now if out is None else out.unionByName(now)
        near = now.select(F.explode(moved(names, 1, zero=True)).alias("_n")).select("_n.*").where(inside(names, F.lit(level)))
        forced = near.select(F.lit(level - 1).alias("level"), *[shift(F.col(k), 1).alias(k) for k in names])
        now = cut(split.where(F.col("level") == level - 1).unionByName(forced).distinct())
    return out.unionByName(now)


def build_tree(particles: DataFrame, d: int = 2, max_particles: int | None = None, kind: str = "adaptive", max_weight: int | None = None, bbox=None, stick_out: float | None = None, norm: str = "linf", prune: bool = True, levels_at_once: int = 8, beyond: bool = False) -> Tree:
    """The tree over particles: pid, coordinates x[, y[, z]] and, optional, role ('s', 't'
    or 'b' for both), radius and weight.

    Either max_particles or max_weight (with a weight column) is the limit of a box.
    Points with a radius need stick_out; they stay at the last box that, enlarged by
    that factor, holds them; such points need a role. Points with a null coordinate are an error. bbox, (low, high) for
    each axis, is the root box; it must be a cube and hold all points. With beyond, it need not hold them: there are as
    many boxes of its size at level 0, beside it, as have points; their keys go on from those inside, and may be negative.
    """
    names = key_names(d)
    if d not in (1, 2, 3):
        raise ValueError("d must be 1, 2 or 3")
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {NORMS}")
    if (max_particles is None) == (max_weight is None):
        raise ValueError("give one of max_particles and max_weight")
    extent = "radius" in particles.columns
    if extent and "role" not in particles.columns:
        raise ValueError("points with a radius need a role")
    if beyond and (bbox is None or kind != "adaptive" or extent or not prune):
        raise ValueError("beyond goes with a bbox, and with adaptive, pruned trees of points without a radius")
    allowed = deepest_level(particles, d)
    if (max_particles if max_particles is not None else max_weight) <= 0:
        raise ValueError("the limit of a box must be positive")
    if extent and stick_out is None:
        raise ValueError("points with a radius need a stick_out factor")
    if max_weight is not None and "weight" not in particles.columns:
        raise ValueError("max_weight needs a weight column")
    role = F.col("role") if "role" in particles.columns else F.lit("b")
    radius = F.col("radius").cast("double") if extent else F.lit(0.0)
    weight = F.col("weight").cast("long") if max_weight is not None else F.lit(1).cast("long")
    points = particles.select("pid", *[F.col(a).cast("double").alias(a) for a in axes(d)], role.alias("role"), radius.alias("radius"), weight.alias("weight"))
    none = [F.count_if(F.col(a).isNull() | F.isnan(a)) for a in axes(d)]
    reach = [f(F.col(a) - sign * F.col("radius")) for a in axes(d) for f, sign in ((F.min, 1), (F.max, -1))]
    limits = points.agg(F.min("weight"), F.max("weight"), F.min("radius"), *none, *reach).first()
    limit = max_particles if max_particles is not None else max_weight
    if any(limits[3 : 3 + d]):
        raise ValueError("a coordinate is missing")
    if limits[0] is not None and (limits[0] < 0 or max_weight is not None and limits[1] > max_weight):
        raise ValueError("weights must be from 0 to max_weight")
    if limits[2] is not None and limits[2] < 0:
        raise ValueError("radii must not be negative")
    if limits[0] is None:
        raise ValueError("there are no points")
    low, high = list(limits[3 + d :: 2]), list(limits[4 + d :: 2])
    lo, hi = checked_box(bbox, low, high, beyond) if bbox is not None else root_box(low, high)

    if beyond:
        # The tree of a cube of such boxes, whose levels above the given box are taken off at the end.
        above, at = _tiles(lo, hi, low, high)
        allowed = min(allowed + above, TOP)
        key = [cell_number(F.col(a), lo[i], hi[i], TOP - above) + (at[i] << (TOP - above)) for i, a in enumerate(axes(d))]
    else:
        above, at = 0, [0] * d
        key = [grid_key(F.col(a), lo[i], hi[i], TOP) for i, a in enumerate(axes(d))]
    keyed = points.select("*", *[k.alias(f"_k{a}") for k, a in zip(key, axes(d))])
    desc = _descends(d, lo, hi, stick_out, norm) if extent else F.lit(TOP + 1)
    keyed = cut(keyed.withColumn("_desc", desc.cast("int")))

    if kind == "non-adaptive":
        depth = _split_cells(keyed, d, limit, levels_at_once, allowed, reached=True)[1] + 1
        final = F.least(F.col("_desc"), F.lit(depth)).cast("int")
        placed = keyed.withColumn("level", final)
        split = None
    else:
        split, deepest = _split_cells(keyed, d, limit, levels_at_once, allowed)
        if kind == "adaptive-level-restricted":
            split = restricted(split, d, deepest)
        depth = deepest + 1
        celled = keyed.select("*", *[shift(F.col(f"_k{a}"), TOP - depth).alias(k) for a, k in zip(axes(d), names)])
        placed = celled.join(_splits_above(celled.select(*names).distinct(), split, d, depth), names, "left").drop(*names)
        placed = placed.withColumn("level", F.greatest(F.least(F.col("_desc"), F.coalesce("_deep", F.lit(0))), F.lit(above)).cast("int"))
    placed = cut(placed.select("pid", *axes(d), "role", "radius", "weight", "level", *[shift(F.col(f"_k{a}"), TOP - F.col("level")).alias(k) for a, k in zip(axes(d), names)]))

    source, target = F.col("role").isin("s", "b").cast("long"), F.col("role").isin("t", "b").cast("long")
    own = placed.groupBy(*box_names(d)).agg(F.count(F.lit(1)).alias("n_own"), F.sum(source).alias("n_src_own"), F.sum(target).alias("n_tgt_own"))
    counts = ["n_own", "n_src_own", "n_tgt_own"]
    up = own.select(F.explode(levels(0, F.col("level"))).alias("_at"), "*")
    at_own = F.col("_at") == F.col("level")
    boxes = up.groupBy(F.col("_at").alias("_level"), *[shift(F.col(k), F.col("level") - F.col("_at")).alias(f"_{k}") for k in names]).agg(
        *[F.sum(F.when(at_own, F.col(c)).otherwise(0)).alias(c) for c in counts],
        *[F.sum(c).alias(c.replace("own", "cumul")) for c in counts],
        F.max(~at_own).alias("_below"),
    )
    boxes = boxes.select(F.col("_level").alias("level"), *[F.col(f"_{k}").alias(k) for k in names], *counts, *[c.replace("own", "cumul") for c in counts], "_below")
    if split is None:
        boxes = boxes.withColumn("is_split", F.col("level") < depth).drop("_below")
        split = boxes.where("is_split").select(*box_names(d))
    else:
        if not prune:
            root = F.array(F.struct(F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(k) for k in names]))
            every = split.select((F.col("level") + 1).alias("level"), F.explode(children(names)).alias("_c")).select("level", "_c.*")
            every = every.unionByName(particles.sparkSession.range(1).select(F.explode(root).alias("_r")).select("_r.*"))
            boxes = every.join(boxes, box_names(d), "left").fillna(0, [*counts, *[c.replace("own", "cumul") for c in counts]])
        boxes = boxes.join(split.withColumn("is_split", F.lit(True)), box_names(d), "left").withColumn("is_split", F.coalesce("is_split", F.lit(False))).drop("_below")
    if beyond:
        boxes, placed, split = (_from_tile(t, d, above, at) for t in (boxes, placed, split))
    return Tree(d, lo, hi, cut(boxes), placed, split, stick_out or 0.0, norm, extent)


def _from_tile(rows: DataFrame, d: int, above: int, at: list[int]) -> DataFrame:
    """Rows of boxes at level above and below, with the levels and keys that they have in the box of keys at on that level."""
    own = F.col("level") - above
    keys = {k: F.col(k) - raised(F.lit(a).cast("long"), own) for k, a in zip(key_names(d), at)}
    return rows.where(F.col("level") >= above).withColumns({**keys, "level": own.cast("int")})


def with_path(boxes: DataFrame, d: int) -> DataFrame:
    return boxes.withColumn("path", path(F.col("level"), [F.col(k) for k in key_names(d)]))


def with_box_ids(tree: Tree) -> DataFrame:
    """The boxes with box_id: by level, and within a level by the way from the root."""
    return numbered(with_path(tree.boxes, tree.d), ["level", "path"], "box_id")


def flags(tree: Tree) -> DataFrame:
    """For each box which kinds of points it holds itself, and whether it has children; a box that
    splits counts as having children of both kinds."""
    own = lambda c: F.col(c) > 0
    return tree.boxes.select(*box_names(tree.d), own("n_src_own").alias("is_source"), own("n_tgt_own").alias("is_target"), F.col("is_split").alias("has_source_child"), F.col("is_split").alias("has_target_child"), (~F.col("is_split")).alias("is_leaf"))


def tree_order(tree: Tree) -> DataFrame:
    """The points with their place in tree order: boxes by the way from the root, a box's own points
    before its children's, sources before targets, then by pid."""
    rows = with_path(tree.particles, tree.d).select("pid", "role", *box_names(tree.d), "path")
    return numbered(rows, ["path", F.when(F.col("role") == "t", 1).otherwise(0), "pid"], "place")


def box_starts(tree: Tree) -> DataFrame:
    """For each box the place of its first point in tree order, with its own and all its points: what the
    boxes before it on the way hold."""
    rows = running(with_path(tree.boxes, tree.d), ["path"], "n_own", "_end")
    return rows.select(*box_names(tree.d), (F.col("_end") - F.col("n_own")).alias("start"), "n_own", "n_cumul")


def level_starts(tree: Tree) -> DataFrame:
    """Boxes a level, and the box_id of the first."""
    from pyspark.sql import Window as W

    n = tree.boxes.groupBy("level").agg(F.count(F.lit(1)).alias("n_boxes"))  # at most TOP + 1 rows
    return n.withColumn("first_box", F.sum("n_boxes").over(W.orderBy("level")) - F.col("n_boxes"))


def box_extents(tree: Tree, roles: tuple[str, ...] = ("s", "t", "b")) -> DataFrame:
    """For each box the least and greatest coordinates of its points of some roles with their radius,
    of its centre and of those of the boxes below it."""
    d = tree.d
    of_points = tree.particles.where(F.col("role").isin(*roles)).groupBy(*box_names(d)).agg(*[f(F.col(a) + s * F.col("radius")).alias(f"{n}_{a}") for a in axes(d) for n, f, s in (("min", F.min, -1), ("max", F.max, 1))])
    of_boxes = tree.boxes.select(*box_names(d), *[tree.center(i, F.col("level"), F.col(k)).alias(f"{n}_{a}") for i, (a, k) in enumerate(zip(axes(d), key_names(d))) for n in ("min", "max")])
    both = of_points.unionByName(of_boxes)
    up = both.select(F.explode(levels(0, F.col("level"))).alias("_at"), "*")
    keys = [shift(F.col(k), F.col("level") - F.col("_at")).alias(f"_{k}") for k in key_names(d)]
    out = up.groupBy("_at", *keys).agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for a in axes(d) for n, f in (("min", F.min), ("max", F.max))])
    return out.select(F.col("_at").alias("level"), *[F.col(f"_{k}").alias(k) for k in key_names(d)], *[f"{n}_{a}" for a in axes(d) for n in ("min", "max")])


def link_point_sources(tree: Tree, point_sources: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Point sources that hang on the tree's points by pid: (each with its place in the tree order of
    its owner, ties by the columns order; for each box its first place and how many it has itself and in all).

    Owners without point sources, and point sources without an owner, are left out; boxes without any have 0.
    """
    owned = point_sources.join(with_path(tree.particles, tree.d).select("pid", *box_names(tree.d), "path"), "pid")
    placed = numbered(owned, ["path", "pid", *order], "psid")
    own = placed.groupBy(*box_names(tree.d)).agg(F.count(F.lit(1)).alias("n_ps_own"))
    return placed, _counted(tree, own, "n_ps_own", "n_ps_cumul", "ps_start")


def _counted(tree: Tree, own: DataFrame, name: str, cumulative: str, start: str) -> DataFrame:
    """Of counts by box: for all boxes the count, that with the boxes below, and that of the boxes before."""
    d = tree.d
    up = own.select(name, F.explode(levels(0, F.col("level"))).alias("_at"), *box_names(d))
    up = up.select(name, F.col("_at").alias("level"), *[shift(F.col(k), F.col("level") - F.col("_at")).alias(k) for k in key_names(d)])
    total = up.groupBy(*box_names(d)).agg(F.sum(name).alias(cumulative))
    rows = with_path(tree.boxes.select(*box_names(d)), d).join(own, box_names(d), "left").join(total, box_names(d), "left").fillna(0, [name, cumulative])
    return running(rows, ["path"], name, "_end").select(*box_names(d), (F.col("_end") - F.col(name)).alias(start), name, cumulative)


def filtered_targets_user_order(tree: Tree, flagged: DataFrame) -> DataFrame:
    """For each box its own targets that are flagged (a table of pid), as a sorted array."""
    chosen = tree.particles.where(F.col("role").isin("t", "b")).join(flagged.select("pid").distinct(), "pid", "left_semi")
    return chosen.groupBy(*box_names(tree.d)).agg(F.sort_array(F.collect_list("pid")).alias("targets"))


def filtered_targets_tree_order(tree: Tree, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flagged targets, numbered in tree order; for each box its first number and how many it has itself and in all."""
    d = tree.d
    chosen = tree.particles.where(F.col("role").isin("t", "b")).join(flagged.select("pid").distinct(), "pid", "left_semi")
    placed = numbered(with_path(chosen.select("pid", *box_names(d)), d), ["path", "pid"], "place")
    own = placed.groupBy(*box_names(d)).agg(F.count(F.lit(1)).alias("n_filtered_own"))
    return placed, _counted(tree, own, "n_filtered_own", "n_filtered_cumul", "filtered_start")
