"""Deep trees, clustered lookups, boxes alone, and what is refused."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrille.functions.drawing import padded_binary
from quadrille.functions.keys import box_names
from quadrille.operators import boxes, classes, fmm, lookup
from quadrille.operators.traversal import Traversal, side
from quadrille.operators.tree import MaxLevelsExceeded, build_tree
from quadrille.plans import registry
from quadrille.plans.shared import rounded
from quadrille.sources.points import normal_points, uniform_points
from tests.compare import check


def line(spark, n, kind="double"):
    """Points that come closer to a corner by halves, and the other corner."""
    rows = [(i, 2.0**-i, 0.0) for i in range(n)] + [(n, 0.0, 0.0)]
    return spark.createDataFrame(rows, f"pid bigint, x {kind}, y {kind}")


def test_more_than_thirty_levels(spark):
    tree = build_tree(line(spark, 45), max_particles=1)
    found = {r["pid"]: tuple(r)[1:] for r in tree.particles.select("pid", *box_names(2)).collect()}
    assert tree.boxes.agg(F.max("level")).first()[0] == 45
    lo, width = tree.lo[0], tree.width
    for pid, (level, ix, iy) in found.items():
        x = 2.0**-pid if pid < 45 else 0.0
        assert ix == int((x - lo) / width * 2**level) and iy == 0
    assert tree.boxes.where("NOT is_split").agg(F.max("n_own")).first()[0] == 1


def test_every_target_sees_every_source_in_a_deep_tree(spark):
    traversal = Traversal(build_tree(line(spark, 34), max_particles=2))
    assert traversal.tree.boxes.agg(F.max("level")).first()[0] > 30
    assert {r["potential"] for r in fmm.drive(traversal, fmm.ConstantOne(2)).collect()} == {35.0}


def test_max_levels(spark):
    same = spark.range(11).select(F.col("id").alias("pid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    with pytest.raises(MaxLevelsExceeded):
        build_tree(same.unionByName(spark.sql("SELECT 99L AS pid, 1D AS x, 1D AS y")), max_particles=10)
    # A float has 24 significant bits, so level 46 is the last; a double tells the same points apart.
    assert build_tree(line(spark, 46, "float"), max_particles=1).boxes.agg(F.max("level")).first()[0] == 46
    with pytest.raises(MaxLevelsExceeded):
        build_tree(line(spark, 49, "float"), max_particles=1)
    assert build_tree(line(spark, 49), max_particles=1).boxes.agg(F.max("level")).first()[0] == 49


@pytest.mark.parametrize("bad,error", [({"x": "float"}, TypeError), ({"x": "string"}, TypeError), ({"radius": "double"}, ValueError)])
def test_points_are_checked(spark, bad, error):
    points = normal_points(spark, 20, 2)
    for name, kind in bad.items():
        points = points.withColumn(name, F.coalesce(F.col(name) if name in points.columns else F.lit(0), F.lit(0)).cast(kind))
    with pytest.raises(error):
        build_tree(points, max_particles=3, stick_out=0.1)


def test_limits_must_be_positive(spark):
    with pytest.raises(ValueError):
        build_tree(normal_points(spark, 20, 2), max_particles=0)


def test_user_box(spark):
    points = uniform_points(spark, 100, 2)
    tree = build_tree(points, max_particles=5, bbox=[(-4, 4), (-4, 4)])
    assert (tree.lo, tree.hi) == ((-4.0, -4.0), (4.0, 4.0))
    # A point on the upper face is in the last cell.
    corner = build_tree(spark.sql("SELECT 1L AS pid, 4D AS x, 4D AS y UNION ALL SELECT 2L, -4D, -4D"), max_particles=1, bbox=[(-4, 4), (-4, 4)])
    assert {(r["ix"], r["iy"]) for r in corner.particles.collect()} == {(0, 0), (1, 1)}


def test_points_beyond_a_user_box(spark):
    points = spark.range(400).select(F.col("id").alias("pid"), (F.rand(1) * 9 - 4).alias("x"), (F.rand(2) * 7 + 0.5).alias("y"))
    with pytest.raises(ValueError):
        build_tree(points, max_particles=8, bbox=[(0, 1), (0, 1)])
    tree = build_tree(points, max_particles=8, bbox=[(0, 1), (0, 1)], beyond=True)
    boxes = {(r["level"], r["ix"], r["iy"]): r for r in tree.boxes.collect()}
    assert min(k[0] for k in boxes) == 0 and min(k[1] for k in boxes) < 0 and sum(r["n_own"] for r in boxes.values()) == 400
    for r in tree.particles.collect():
        assert (r["ix"], r["iy"]) == tuple(math.floor(r[a] * 2 ** r["level"]) for a in "xy")
    for (level, ix, iy), r in boxes.items():
        assert r["is_split"] == (r["n_cumul"] > 8) and (level == 0 or boxes[level - 1, ix >> 1, iy >> 1]["is_split"])


def test_few_points_beyond_a_user_box(spark):
    """No cell of the cube of boxes splits: each box with a point is at level 0."""
    points = spark.sql("SELECT 1L AS pid, -9.5D AS x, 0.5D AS y UNION ALL SELECT 2L, 6.5D, 0.5D")
    tree = build_tree(points, max_particles=5, bbox=[(0, 1), (0, 1)], beyond=True)
    assert {(r["level"], r["ix"], r["iy"], r["n_own"], r["is_split"]) for r in tree.boxes.collect()} == {(0, -10, 0, 1, False), (0, 6, 0, 1, False)}


def test_query_with_orders_beyond_its_box(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.unionByName(orders.withColumns({"o_orderkey": F.col("o_orderkey") + 10_000, "o_custkey": F.col("o_custkey") + 120_000})).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    check(registry.queries()["tree_user_bbox"](spark, str(tmp_path)), con, registry.oracle_sql()["tree_user_bbox"])


def clustered(spark):
    near = spark.range(3000).select(F.col("id").alias("pid"), *[(F.rand(seed=i) / 1024).alias(a) for i, a in enumerate("xy")])
    return near.unionByName(spark.sql("SELECT 99999L AS pid, 1D AS x, 1D AS y"))


@pytest.mark.parametrize("name", ["area_query", "area_query_elementwise", "leaves_to_balls", "space_invader"])
def test_balls_are_not_broadcast(spark, tmp_path, name):
    """A small file of balls, each of which becomes many rows: neither they nor the leaves go to all executors as a whole."""
    spark.range(5000).select(F.col("id").alias("ball_id"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.lit(0.01).alias("radius")).write.parquet(str(tmp_path / "balls"))
    found = getattr(lookup, name)(build_tree(uniform_points(spark, 500, 2), max_particles=5), spark.read.parquet(str(tmp_path / "balls")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "Join" in line and "_ix#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_clustered_leaves_share_no_key(spark, monkeypatch):
    """All leaves but a few are below one cell, on ten levels."""
    monkeypatch.setattr(lookup, "PART", 100)
    tree = build_tree(clustered(spark), max_particles=2)
    n = tree.leaves().count()
    leaves, heavy = lookup.keyed_leaves(tree, [4, 6, 8, 9])
    keys = ["_same", "_part", "_level", "_ix", "_iy"]
    assert n > 1500 and heavy.count() >= 4
    assert leaves.groupBy(*keys).count().agg(F.max("count")).first()[0] < 2.5 * 100
    balls = spark.range(40).select(F.col("id").alias("ball_id"), *[(F.rand(seed=9 + i) / 700).alias(a) for i, a in enumerate("xy")], F.pow(F.lit(2.0), -(F.col("id") % 11) - 3).alias("radius"))
    found = {tuple(r) for r in lookup.area_query(tree, balls).select("ball_id", *box_names(2)).collect()}
    boxes_ = [tuple(r) for r in tree.leaves().select(*box_names(2)).collect()]
    want = set()
    for b in balls.collect():
        for level, ix, iy in boxes_:
            w = tree.width / 2**level
            apart = max(abs(b[a] - (tree.lo[i] + (k + 0.5) * w)) for i, (a, k) in enumerate((("x", ix), ("y", iy))))
            if apart <= b["radius"] + w / 2:
                want.add((b["ball_id"], level, ix, iy))
    assert found == want and len(want) > 1000


def test_balls_are_checked(spark):
    tree = build_tree(uniform_points(spark, 100, 2), max_particles=5)
    ball = "SELECT 1L AS ball_id, 0D AS x, 0D AS y, {} AS radius"
    with pytest.raises(Exception, match="radii must not be negative"):
        lookup.area_query(tree, spark.sql(ball.format("-0.1D"))).collect()
    with pytest.raises(TypeError):
        lookup.area_query(tree, spark.sql(ball.format("'a'")))
    with pytest.raises(ValueError):
        lookup.area_query(tree, spark.sql(ball.format("1D")).drop("y"))
    assert lookup.area_query(tree, spark.sql(ball.format("CAST(NULL AS DOUBLE)"))).count() == 0


def test_class_numbers(spark):
    for n, d in ((1, 2), (2, 2), (1, 3)):
        assert [classes.class_number(classes.class_vector(i, n, d), n) for i in range(classes.class_count(n, d))] == list(range(classes.class_count(n, d)))
    traversal = Traversal(build_tree(uniform_points(spark, 400, 2), max_particles=5))
    far = spark.createDataFrame([(4, 0, 0, 4, 9, 0)], ", ".join(f"{c} {'int' if 'level' in c else 'bigint'}" for c in (*side("t", 2), *side("s", 2))))
    with pytest.raises(Exception, match="too far apart"):
        classes.translation_classes(traversal, edges=far).collect()
    with pytest.raises(ValueError):
        classes.translation_classes(Traversal(traversal.tree, 10**9))


def test_bound_of_rotation_classes(spark, monkeypatch):
    traversal = Traversal(build_tree(uniform_points(spark, 400, 2), max_particles=5))
    assert classes.rotation_classes(traversal).agg(F.max("rotation_class")).first()[0] < classes.most_rotation_classes(1, 2)
    monkeypatch.setattr(classes, "most_rotation_classes", lambda n, d: 2)
    with pytest.raises(Exception, match="more rotation classes"):
        classes.rotation_classes(traversal).collect()


def test_boxes_alone_as_a_tree(spark):
    tree = boxes.refine_uniformly(boxes.root(spark, 2, [(0, 1), (0, 1)]), 2)
    tree = boxes.refine(tree, tree.where("ix = 0 AND iy = 0 AND level = 1"), 2)
    t = Traversal(boxes.as_tree(tree, 2, [(0, 1), (0, 1)]))
    level2 = {(2, x, y) for x in (0, 1) for y in (0, 1)}
    level1 = {(1, x, y) for x in (0, 1) for y in (0, 1)}
    pairs = {(tuple(r)[:3], tuple(r)[3:]) for r in t.list1.select(*side("t", 2), *side("s", 2)).collect()}
    every = level1 | level2 | {(0, 0, 0)}
    corner = {((2, 0, 0), (1, 0, 1)), ((2, 0, 0), (1, 1, 0)), ((2, 0, 0), (1, 1, 1)), ((2, 1, 0), (1, 0, 1)), ((2, 0, 1), (1, 1, 0))}
    # All touch but the small boxes that end in the middle: (2, 1, 0) reaches from a quarter to a half.
    assert pairs == {(a, b) for a in every for b in every} - {(a, b) for a, b in _apart(every)}
    assert corner & pairs == {(a, b) for a, b in corner if (a, b) not in _apart(every)}
    ids = {tuple(r)[:3]: r["box_id"] for r in boxes.with_ids(tree, 2).select("level", "ix", "iy", "box_id").collect()}
    assert sorted(ids.values()) == list(range(9)) and ids[0, 0, 0] == 0 and ids[2, 0, 0] == 5


def _apart(every):
    def gap(a, b):
        spans = lambda box: [(k << (3 - box[0]), (k + 1) << (3 - box[0])) for k in box[1:]]
        return max(max(p[0], q[0]) - min(p[1], q[1]) for p, q in zip(spans(a), spans(b)))

    return {(a, b) for a in every for b in every if gap(a, b) > 0}


@pytest.mark.parametrize("bbox", [[(0, 1)], [(0, 1), (0, 2)], [(0, 0), (0, 0)]])
def test_root_box_must_be_a_cube(spark, bbox):
    with pytest.raises(ValueError):
        boxes.root(spark, 2, bbox)


def test_long_numbers_stay_whole_in_base_2(spark):
    rows = spark.range(1).select(padded_binary(F.lit(5), 4), padded_binary(F.lit(4097), 12), padded_binary(F.lit(0), 3)).first()
    assert tuple(rows) == ("0101", "1000000000001", "000")


def test_rounding_is_that_of_the_sql(spark):
    """The centre of a box of level 3 whose tenth decimal is as good as a half, and others."""
    values = [7.5 * (600.0593332666666 / 8), -7.5 * (600.0593332666666 / 8), 0.0, 1 / 3, 2.5e-9]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 9)).collect()]
    assert found == [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 9)").fetchall()[0][0] for v in values]
