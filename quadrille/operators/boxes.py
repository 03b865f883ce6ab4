"""Trees of boxes without points: refining and coarsening.

A tree is a table (level, keys, is_leaf); flags are tables of boxes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.functions.keys import axes, box_names, children, key_names, power2, shift
from quadrille.functions.ordering import numbered
from quadrille.operators.tree import Tree, with_path
from quadrille.plans.shared import cut


def root(spark: SparkSession, d: int, bbox=None) -> DataFrame:
    """The root box alone. bbox, (low, high) for each axis, is checked to be a cube."""
    if bbox is not None:
        if len(bbox) != d:
            raise ValueError("the bounding box needs a pair for each axis")
        cube_of(bbox)
    return spark.range(1).select(F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(k) for k in key_names(d)], F.lit(True).alias("is_leaf"))


def cube_of(bbox) -> tuple[tuple[float, ...], float]:
    """The low corner and the width of a bounding box that is given as (low, high) for each axis; it must be a cube."""
    widths = [float(high) - float(low) for low, high in bbox]
    if min(widths) <= 0 or not all(math.isclose(w, widths[0], rel_tol=1e-5, abs_tol=1e-8) for w in widths):
        raise ValueError("the bounding box must have the same width on all axes")
    return tuple(float(low) for low, _ in bbox), widths[0]


def as_tree(tree: DataFrame, d: int, bbox) -> Tree:
    """Boxes alone as a tree that lists can be made of: each box is a source and a target, and there are no points."""
    lo, width = cube_of(bbox)
    boxes = cut(tree.select(*box_names(d), (~F.col("is_leaf")).alias("is_split")))
    return Tree(d, lo, tuple(l + width for l in lo), boxes, None, boxes.where("is_split").select(*box_names(d)))


def with_ids(tree: DataFrame, d: int) -> DataFrame:
    """The boxes with box_id from 0, by level and then by the way from the root, whatever was refined or removed before."""
    return numbered(with_path(tree, d), ["level", "path"], "box_id").drop("path")


def with_leaves(boxes: DataFrame, d: int) -> DataFrame:
    """boxes (level, keys) with is_leaf: whether no box is below."""
    parents = boxes.where("level > 0").select((F.col("level") - 1).alias("level"), *[shift(F.col(k), 1).alias(k) for k in key_names(d)], F.lit(True).alias("_parent")).distinct()
    return boxes.select(*box_names(d)).join(parents, box_names(d), "left").select(*box_names(d), F.col("_parent").isNull().alias("is_leaf"))


def _split(leaves: DataFrame, d: int) -> DataFrame:
    return leaves.select((F.col("level") + 1).alias("level"), F.explode(children(key_names(d))).alias("_c")).select("level", "_c.*", F.lit(True).alias("is_leaf"))


def refine(tree: DataFrame, flagged: DataFrame, d: int) -> DataFrame:
    """The tree with the flagged leaves split; flags on other boxes are an error."""
    flags = flagged.select(*box_names(d)).distinct().withColumn("_flag", F.lit(True))
    marked = tree.join(flags, box_names(d), "left").withColumn("_flag", F.coalesce("_flag", F.lit(False)))
    if marked.where("_flag AND NOT is_leaf").take(1):
        raise ValueError("only leaves can be refined")
    kept = marked.select(*box_names(d), (F.col("is_leaf") & ~F.col("_flag")).alias("is_leaf"))
    return kept.unionByName(_split(marked.where("_flag"), d))


def refine_uniformly(tree: DataFrame, d: int) -> DataFrame:
    return refine(tree, tree.where("is_leaf"), d)


def coarsen(tree: DataFrame, flagged: DataFrame, d: int, error_on_ignored: bool = True) -> DataFrame:
    """The tree without the siblings of flagged leaves, flagged or not, where all of them are leaves.

    A flag on a leaf with a sibling that is no leaf cannot be followed: it is an error, or is
    passed over. Flags on other boxes and on the root are an error.
    """
    names = key_names(d)
    up = [(F.col("level") - 1).alias("level"), *[shift(F.col(k), 1).alias(k) for k in names]]
    flags = tree.join(flagged.select(*box_names(d)).distinct(), box_names(d), "left_semi")
    if flags.where("NOT is_leaf OR level = 0").take(1):
        raise ValueError("only leaves below the root can be coarsened")
    families = tree.where("level > 0").select(*up, "is_leaf").groupBy(*box_names(d)).agg(F.min("is_leaf").alias("_all"))
    asked = flags.select(*up).distinct().join(families, box_names(d))
    if error_on_ignored and asked.where("NOT _all").take(1):
        raise ValueError("a flagged leaf has a sibling that is not a leaf")
    merged = asked.where("_all").select(*box_names(d))
    gone = merged.select((F.col("level") + 1).alias("level"), F.explode(children(names)).alias("_c")).select("level", "_c.*")
    kept = tree.join(gone, box_names(d), "left_anti")
    return kept.join(merged.withColumn("_leaf", F.lit(True)), box_names(d), "left").select(*box_names(d), (F.col("is_leaf") | F.coalesce("_leaf", F.lit(False))).alias("is_leaf"))


def refine_and_coarsen(tree: DataFrame, to_refine: DataFrame, to_coarsen: DataFrame, d: int, error_on_ignored: bool = True) -> DataFrame:
    """Refine, then coarsen. No box may be flagged for both; leaves that came to have a refined sibling stay."""
    if to_refine.select(*box_names(d)).join(to_coarsen, box_names(d), "left_semi").take(1):
        raise ValueError("a box is flagged for both")
    return coarsen(refine(tree, to_refine, d), to_coarsen, d, error_on_ignored)


def leaf_vertices(tree: DataFrame, d: int, lo: tuple[float, ...], width: float) -> DataFrame:
    """The corners of each leaf: vertex (its number, the first axis being the most significant bit) and coordinates."""
    rows = tree.where("is_leaf").select(*box_names(d), F.explode(F.sequence(F.lit(0), F.lit((1 << d) - 1))).alias("vertex"))
    step = F.lit(width) / power2(F.col("level"))
    bit = lambda i: F.call_function("shiftright", F.col("vertex"), F.lit(d - 1 - i)).bitwiseAND(F.lit(1))
    return rows.select("*", *[(F.lit(lo[i]) + (F.col(k) + bit(i)) * step).alias(a) for i, (a, k) in enumerate(zip(axes(d), key_names(d)))])
