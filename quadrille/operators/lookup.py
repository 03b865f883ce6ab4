"""Geometric lookups: peer boxes, balls against leaf boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from quadrille.functions.keys import axes, box_names, key_names, levels, power2, raised, shift
from quadrille.operators.traversal import prefixed, side, touching
from quadrille.operators.tree import Tree
from quadrille.plans.shared import cut

#: A cell with more leaves below is looked up in parts of about so many.
PART = 4096


def peers(tree: Tree) -> DataFrame:
    """For each box (t_) the boxes (s_) that touch it, are as large or larger, and have no child that
    does both; the root's peer is itself. A larger box that holds it is never one: its child on the way does both."""
    d = tree.d
    pairs = touching(prefixed(tree.boxes, "t", d), "t", prefixed(tree.boxes, "s", d), "s", d).select(*side("t", d), *side("s", d))
    parents = pairs.where("s_level > 0").select(*side("t", d), (F.col("s_level") - 1).alias("s_level"), *[shift(F.col(f"s_{k}"), 1).alias(f"s_{k}") for k in key_names(d)])
    return pairs.join(parents, [*side("t", d), *side("s", d)], "left_anti")


def area_query(tree: Tree, balls: DataFrame) -> DataFrame:
    """Pairs of a ball and a leaf box that it overlaps in the maximum norm, edges included.

    balls: ball_id, coordinates, radius. A ball is looked up at the deepest level whose
    boxes are at least as large as it, where it overlaps few cells: leaves below are
    known there by their ancestor, larger leaves at their own level. The candidates of
    this equi-join are then tested exactly. Only levels that have leaves, or balls whose
    deepest it is, take part, and the leaves below a cell that has many, on whatever level it is, are
    dealt to parts by their number.
    Balls with a null are in no pair; a negative radius is an error. The result has the ball's columns, prefixed by
    ball_, and the leaf's keys.
    """
    d, names = tree.d, key_names(tree.d)
    balls = _checked(balls, d)
    on_leaves = sorted(r["level"] for r in tree.leaves().select("level").distinct().collect())  # at most TOP + 1
    usable = balls.dropna(subset=["radius", *axes(d)])
    fits = F.size(F.filter(levels(1, F.lit(on_leaves[-1])), lambda l: F.col("radius") <= F.lit(tree.width) / power2(l) / 2))
    at = usable.select(F.col("ball_id"), *[F.col(a).alias(f"ball_{a}") for a in axes(d)], F.col("radius").alias("ball_radius"), fits.alias("_deep"))
    on_balls = sorted(r["_deep"] for r in at.select("_deep").distinct().collect())  # at most TOP + 1
    # At its deepest level a ball also looks for the leaves below, at the others for leaves of just that level.
    at = at.withColumn("_level", F.explode(F.filter(levels(0, F.col("_deep")), lambda l: l.isin(*on_leaves) | (l == F.col("_deep")))))
    at = at.withColumn("_same", F.explode(F.when(F.col("_level") == F.col("_deep"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    width, last = F.lit(tree.width) / power2(F.col("_level")), raised(F.lit(1).cast("long"), F.col("_level")) - 1
    for i, (a, k) in enumerate(zip(axes(d), names)):
        cell = lambda v: F.floor((v - F.lit(tree.lo[i])) / width)
        first = F.greatest(cell(F.col(f"ball_{a}") - F.col("ball_radius")) - 1, F.lit(0)).cast("long")
        end = F.least(cell(F.col(f"ball_{a}") + F.col("ball_radius")) + 1, last).cast("long")
        at = at.withColumn(f"_{k}", F.explode(F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))))
    leaves, heavy = keyed_leaves(tree, on_balls)
    at = at.join(heavy, ["_same", *_cell(d)], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    # Spark takes the exploded balls to be as small as the table that they come from, and would broadcast them.
    found = at.join(leaves.hint("merge"), ["_same", "_part", *_cell(d)])
    return found.where(distance(tree) <= F.col("ball_radius") + tree.radius(F.col("level"))).select("ball_id", *[f"ball_{a}" for a in axes(d)], "ball_radius", *box_names(d))


def _cell(d: int) -> list[str]:
    return ["_level", *[f"_{k}" for k in key_names(d)]]


def _checked(balls: DataFrame, d: int) -> DataFrame:
    """balls, if they have numbers for their centres and radii; a negative radius fails when it is read."""
    for c in ("radius", *axes(d)):
        if c not in balls.columns:
            raise ValueError(f"balls need the column {c}")
        if not isinstance(balls.schema[c].dataType, NumericType):
            raise TypeError(f"the balls' column {c} must hold numbers")
    if "ball_id" not in balls.columns:
        raise ValueError("balls need the column ball_id")
    radius = F.when(F.col("radius") < 0, F.raise_error(F.lit("radii must not be negative")).cast("double")).otherwise(F.col("radius").cast("double"))
    return balls.select("ball_id", *axes(d), radius.alias("radius"))


def keyed_leaves(tree: Tree, on: list[int]) -> tuple[DataFrame, DataFrame]:
    """The leaves by the cells (_level, _ix, ..) that they are in at the levels on, with _same set where that is their own level,
    and the _part of the cell's leaves that they are in; and the cells in several parts, with their number _parts.

    A cell has so many parts that none holds many more than PART leaves: so a key is not larger where points are clustered.
    """
    d, names = tree.d, key_names(tree.d)
    known = F.filter(levels(0, F.col("level")), lambda l: l.isin(*on, -1) | (l == F.col("level")))
    leaves = tree.leaves().select(*box_names(d), F.explode(known).alias("_level"))
    leaves = leaves.select("*", (F.col("level") == F.col("_level")).alias("_same"), *[shift(F.col(k), F.col("level") - F.col("_level")).alias(f"_{k}") for k in names])
    counts = leaves.where("NOT _same").groupBy("_same", *_cell(d)).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    heavy = cut(counts.where("_parts > 1"))
    dealt = leaves.join(heavy, ["_same", *_cell(d)], "left")
    return dealt.withColumn("_part", F.pmod(F.hash(*names), F.coalesce("_parts", F.lit(1)))).drop("_parts"), heavy


def distance(tree: Tree) -> Column:
    """The distance of a ball's centre and a leaf's in the maximum norm."""
    apart = [F.abs(F.col(f"ball_{a}") - tree.center(i, F.col("level"), F.col(f"i{a}"))) for i, a in enumerate(axes(tree.d))]
    return F.greatest(F.lit(0.0), *apart)


def leaves_to_balls(tree: Tree, balls: DataFrame) -> DataFrame:
    """For each leaf that a ball overlaps the balls, as a sorted array."""
    return area_query(tree, balls).groupBy(*box_names(tree.d)).agg(F.sort_array(F.collect_list("ball_id")).alias("balls"))


def space_invader(tree: Tree, balls: DataFrame) -> DataFrame:
    """For each leaf the largest distance to the centre of a ball that overlaps it, else 0."""
    d = tree.d
    outer = area_query(tree, balls).withColumn("_far", distance(tree)).groupBy(*box_names(d)).agg(F.max("_far").alias("outer_space_invader_dist"))
    return tree.leaves().select(*box_names(d)).join(outer, box_names(d), "left").fillna(0.0, ["outer_space_invader_dist"])


def area_query_elementwise(tree: Tree, balls: DataFrame, **columns: Callable[[Tree], Column]) -> DataFrame:
    """The pairs of area_query with more columns, each from a function of the tree that gives a Column on
    the pairs' columns."""
    return area_query(tree, balls).select("*", *[f(tree).alias(name) for name, f in columns.items()])
