"""Invariants of trees, lists and sums, on points of one, two and three dimensions."""

import itertools

import pytest
from pyspark.sql import functions as F

from quadrille.functions.keys import box_names
from quadrille.operators import boxes, fmm, partition
from quadrille.operators.traversal import Traversal
from quadrille.operators.tree import MaxLevelsExceeded, build_tree, tree_order, with_box_ids
from quadrille.sources.points import normal_points, surface_points, uniform_points


def test_counts_and_capacity(spark):
    tree = build_tree(normal_points(spark, 600, 3), d=3, max_particles=20)
    rows = tree.boxes.collect()
    assert sum(r["n_own"] for r in rows) == 600
    assert all(r["n_cumul"] <= 20 for r in rows if not r["is_split"])
    assert all(r["n_cumul"] > 20 for r in rows if r["is_split"])
    by_key = {(r["level"], r["ix"], r["iy"], r["iz"]): r for r in rows}
    for (level, *keys), r in by_key.items():
        if r["is_split"]:
            kids = [by_key[k] for bits in itertools.product((0, 1), repeat=3) if (k := (level + 1, *(2 * a + b for a, b in zip(keys, bits)))) in by_key]
            assert sum(k["n_cumul"] for k in kids) + r["n_own"] == r["n_cumul"]


def test_points_are_in_their_boxes(spark):
    tree = build_tree(surface_points(spark, 300, 2), max_particles=10)
    for r in tree.particles.collect():
        w = tree.width / 2 ** r["level"]
        for axis, lo in zip("xy", tree.lo):
            low = lo + r[f"i{axis}"] * w
            assert low - 1e-12 * tree.width <= r[axis] <= low + w + 1e-12 * tree.width


def test_order_is_a_permutation_and_ids_go_by_level(spark):
    tree = build_tree(normal_points(spark, 200, 2), max_particles=10)
    assert sorted(r["place"] for r in tree_order(tree).collect()) == list(range(200))
    ids = with_box_ids(tree).orderBy("box_id").collect()
    assert [r["box_id"] for r in ids] == list(range(len(ids)))
    assert [r["level"] for r in ids] == sorted(r["level"] for r in ids)


def test_restricted_leaves_differ_by_one_level(spark):
    tree = build_tree(surface_points(spark, 500, 2), max_particles=4, kind="adaptive-level-restricted", prune=False)
    leaves = [(r["level"], r["ix"], r["iy"]) for r in tree.leaves().collect()]
    top = max(x[0] for x in leaves)
    span = [(level, *(v for k in keys for v in (k << (top - level), (k + 1) << (top - level)))) for level, *keys in leaves]
    for a, b in itertools.combinations(span, 2):
        if max(a[1], b[1]) <= min(a[2], b[2]) and max(a[3], b[3]) <= min(a[4], b[4]):
            assert abs(a[0] - b[0]) <= 1


def test_equal_points_are_too_deep(spark):
    same = spark.range(11).select(F.col("id").alias("pid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).unionByName(spark.sql("SELECT 99L AS pid, 1D AS x, 1D AS y"))
    with pytest.raises(MaxLevelsExceeded):
        build_tree(same, max_particles=10)


def test_deep_tree(spark):
    line = spark.range(15).select(F.explode(F.array(F.struct((F.col("id") * 2).alias("pid"), F.pow(F.lit(2.0), -F.col("id")).alias("x")), F.struct((F.col("id") * 2 + 1).alias("pid"), (3 - F.pow(F.lit(2.0), -F.col("id"))).alias("x")))).alias("p")).select("p.pid", "p.x", F.lit(0.0).alias("y"))
    assert build_tree(line, max_particles=2, levels_at_once=3).boxes.agg(F.max("level")).first()[0] >= 13


@pytest.mark.parametrize("bad", [{}, {"max_particles": 3, "max_weight": 5}, {"max_particles": 3, "kind": "other"}, {"max_particles": 3, "norm": "l1"}, {"max_weight": 3}, {"max_particles": 3, "bbox": [(0, 1), (0, 2)]}, {"max_particles": 3, "bbox": [(0, 1), (0, 1)]}])
def test_arguments(spark, bad):
    with pytest.raises(ValueError):
        build_tree(normal_points(spark, 20, 2), **bad)


def test_no_points_and_missing_coordinates(spark):
    with pytest.raises(ValueError):
        build_tree(normal_points(spark, 0, 2), max_particles=3)
    with pytest.raises(ValueError):
        build_tree(spark.sql("SELECT 1L AS pid, CAST(NULL AS DOUBLE) AS x, 1D AS y"), max_particles=3)


def _roles(points, radius=False):
    more = [F.when(F.col("pid") % 3 == 0, "t").otherwise("s").alias("role")]
    return points.select("*", *more, *[F.when(F.col("pid") % 3 == 0, F.pow(F.lit(2.0), -(F.col("pid") % 7 + 3))).otherwise(0.0).alias("radius")] * radius)


@pytest.mark.parametrize("d,n,kind,extent,criterion", [(1, 1, "adaptive", False, None), (2, 2, "adaptive", False, None), (3, 1, "adaptive", False, None), (2, 1, "adaptive-level-restricted", False, None), (2, 1, "non-adaptive", False, None), (2, 1, "adaptive", True, "precise_linf"), (2, 2, "adaptive", True, "static_l2"), (3, 1, "adaptive", True, "static_linf")])
def test_every_target_sees_every_source_once(spark, d, n, kind, extent, criterion):
    points = _roles(normal_points(spark, 240, d), extent)
    more = {"stick_out": 0.25, "norm": "l2" if criterion == "static_l2" else "linf"} if extent else {}
    traversal = Traversal(build_tree(points, d=d, max_particles=12, kind=kind, **more), n, criterion, 6 if extent else 0)
    seen = fmm.drive(traversal, fmm.ConstantOne(d)).collect()
    assert len(seen) == 80 and {r["potential"] for r in seen} == {160.0}


def test_lists_3_and_4_are_dual(spark):
    traversal = Traversal(build_tree(surface_points(spark, 300, 2), max_particles=5))
    edges = lambda df, a, b: {tuple(r[f"{x}_{c}"] for x in (a, b) for c in box_names(2)) for r in df.collect()}
    own = {tuple(r) for r in traversal.target_boxes.collect()}
    three = edges(traversal.list3, "t", "s")
    assert three and {(b, a) for a, b in ((e[:3], e[3:]) for e in three) if b in own} == {(e[:3], e[3:]) for e in edges(traversal.list4, "t", "s") if e[:3] in own}


def test_laplace_expansions_against_direct_sums(spark):
    points = uniform_points(spark, 200, 2)
    traversal = Traversal(build_tree(points, max_particles=8))
    found = {r["pid"]: r["potential"] for r in fmm.drive(traversal, fmm.Laplace2D(traversal, 18)).collect()}
    t, s = points.select(F.col("pid"), F.col("x").alias("t_x"), F.col("y").alias("t_y")), points.select(F.col("pid").alias("q"), F.col("x").alias("s_x"), F.col("y").alias("s_y"))
    want = {r["pid"]: r["v"] for r in t.join(s, F.col("pid") != F.col("q")).groupBy("pid").agg((F.sum(F.log(fmm.squared_distance(2))) / (-4 * 3.141592653589793)).alias("v")).collect()}
    assert max(abs(found[p] - want[p]) for p in want) < 1e-5 * max(map(abs, want.values()))


def test_lists_are_made_by_equi_joins(spark):
    traversal = Traversal(build_tree(normal_points(spark, 100, 2), max_particles=10))
    for name in ("colleagues", "list1", "list2", "list4"):
        plan = getattr(traversal, name)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_boxes_alone(spark):
    tree = boxes.refine_uniformly(boxes.refine_uniformly(boxes.root(spark, 2), 2), 2)
    assert tree.where("is_leaf").count() == 16
    one = tree.where("level = 2 AND ix = 0 AND iy = 0")
    finer = boxes.refine(tree, one, 2)
    assert finer.where("is_leaf").count() == 19
    with pytest.raises(ValueError):
        boxes.refine(finer, one, 2)
    sibling = finer.where("level = 2 AND ix = 1 AND iy = 0")
    with pytest.raises(ValueError):
        boxes.coarsen(finer, sibling, 2)
    assert boxes.coarsen(finer, sibling, 2, error_on_ignored=False).where("is_leaf").count() == 19
    back = boxes.coarsen(finer, finer.where("level = 3 AND ix = 0 AND iy = 0"), 2)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in tree.collect()}


def test_more_workers_than_boxes(spark):
    tree = build_tree(normal_points(spark, 20, 2), max_particles=30)
    with pytest.raises(ValueError):
        partition.partition_work(tree, tree.boxes.select(*box_names(2), F.lit(1.0).alias("cost")), 2)


def test_rotation_classes_in_space(spark):
    """One class for each angle to the last axis, also where vectors of unlike lengths have it."""
    from quadrille.operators.classes import rotation_classes
    from quadrille.operators.traversal import Traversal
    from quadrille.operators.tree import build_tree

    points = spark.range(3000).select(F.col("id").alias("pid"), *[F.rand(seed=i).alias(a) for i, a in enumerate("xyz")])
    rows = rotation_classes(Traversal(build_tree(points, d=3, max_particles=40))).collect()
    angles = {}
    for r in rows:
        angles.setdefault(round(r["angle"], 9), set()).add(r["rotation_class"])
    assert len(angles) > 10 and all(len(c) == 1 for c in angles.values())
    assert sorted(min(c) for c in angles.values()) == list(range(len(angles)))
