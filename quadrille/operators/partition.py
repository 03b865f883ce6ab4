"""Dividing a tree's boxes among workers by cost, and what each worker needs of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille.functions.keys import box_names, key_names, levels, path, shift
from quadrille.functions.ordering import numbered, running
from quadrille.operators.traversal import Traversal, side
from quadrille.operators.tree import Tree


def dfs_order(boxes: DataFrame, d: int) -> DataFrame:
    """boxes with dfs: the place in a walk from the root that visits a box's last child first."""
    last = (1 << d) - 1
    way = F.translate(path(F.col("level"), [F.col(k) for k in key_names(d)]), "".join(map(str, range(last + 1))), "".join(map(str, range(last, -1, -1))))
    return numbered(boxes.withColumn("_way", way), ["_way"], "dfs").drop("_way")


def partition_work(tree: Tree, cost_per_box: DataFrame, workers: int) -> DataFrame:
    """The worker (rank) of each box: runs of the dfs order with about the same cost.

    A run ends with the box at which the running cost passes the next multiple of the mean
    cost, and at most one run ends at a box. With w the multiples passed up to a box,
    the runs ended by then are the least of i + 1 and w_j + i - j over the boxes j up to
    the box i: a running minimum.
    """
    boxes = tree.boxes.count()
    if workers > boxes:
        raise ValueError("there are fewer boxes than workers")
    total = cost_per_box.agg(F.sum("cost")).first()[0]
    placed = dfs_order(tree.boxes.select(*box_names(tree.d)).join(cost_per_box, box_names(tree.d)), tree.d)
    summed = running(placed, ["dfs"], "cost", "_sum")
    passed = F.size(F.filter(levels(1, F.lit(workers)), lambda k: F.col("_sum") > k * F.lit(total) / workers)).cast("long")
    slack = running(summed.withColumn("_slack", passed - F.col("dfs")), ["dfs"], "_slack", "_least", how="min")
    ended = F.least(F.col("dfs") + 1, F.col("_least") + F.col("dfs"))
    # The run a box is in is the number of runs that ended before it.
    at = slack.select(*box_names(tree.d), "cost", "dfs", ended.alias("_ended"))
    before = at.select((F.col("dfs") + 1).alias("dfs"), F.col("_ended").alias("_before"))
    rank = F.least(F.coalesce("_before", F.lit(0)), F.lit(workers - 1)).cast("int")
    return at.join(before, "dfs", "left").select(*box_names(tree.d), "dfs", rank.alias("rank"))


def with_ancestors(owned: DataFrame, d: int) -> DataFrame:
    """The owned boxes (with rank) and all boxes above them."""
    up = owned.select("rank", F.explode(levels(0, F.col("level"))).alias("_at"), *box_names(d))
    return up.select("rank", F.col("_at").alias("level"), *[shift(F.col(k), F.col("level") - F.col("_at")).alias(k) for k in key_names(d)]).distinct()


def box_masks(traversal: Traversal, ranks: DataFrame) -> DataFrame:
    """(rank, box, mask) for the masks responsible, ancestor (boxes above those, but not of them),
    point_source (boxes whose sources a worker needs) and multipole_source (whose multipoles)."""
    d = traversal.tree.d
    owned = ranks.select("rank", *box_names(d))
    above = with_ancestors(owned, d)

    def sources(edges: DataFrame, of: DataFrame) -> DataFrame:
        t = of.select("rank", *[F.col(c).alias(f"t_{c}") for c in box_names(d)])
        return edges.join(t, side("t", d)).select("rank", *[F.col(f"s_{c}").alias(c) for c in box_names(d)])

    points = owned.unionByName(sources(traversal.list1, owned)).unionByName(sources(traversal.list4, above))
    if traversal.tree.has_extent:
        points = points.unionByName(sources(traversal.list3_close, owned)).unionByName(sources(traversal.list4_close, above))
    multipoles = sources(traversal.list2, above).unionByName(sources(traversal.list3, owned))
    masks = {"responsible": owned, "ancestor": above.join(owned, ["rank", *box_names(d)], "left_anti"), "point_source": points.distinct(), "multipole_source": multipoles.distinct()}
    out = None
    for name, boxes in masks.items():
        part = boxes.select("rank", *box_names(d), F.lit(name).alias("mask"))
        out = part if out is None else out.unionByName(part)
    return out


def box_users(masks: DataFrame, d: int) -> DataFrame:
    """For each box the workers that need its multipole, as a sorted array."""
    return masks.where("mask = 'multipole_source'").groupBy(*box_names(d)).agg(F.sort_array(F.collect_set("rank")).alias("ranks"))


def local_particles(tree: Tree, masks: DataFrame) -> DataFrame:
    """The points of each worker's local tree: its own targets and the sources it needs."""
    d = tree.d
    boxes = lambda mask: masks.where(F.col("mask") == mask).select("rank", *box_names(d))
    part = lambda roles, mask, kind: tree.particles.where(F.col("role").isin(*roles)).join(boxes(mask), box_names(d)).select("rank", "pid", *box_names(d), F.lit(kind).alias("kind"))
    return part(("s", "b"), "point_source", "source").unionByName(part(("t", "b"), "responsible", "target"))
