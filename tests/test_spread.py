"""That work is spread: no key is looked up by all rows, numbering takes one shuffle; results against plain versions."""

import itertools

from pyspark.sql import functions as F

from quadrille.functions.keys import box_names
from quadrille.functions.ordering import numbered, running, running_within
from quadrille.operators.lookup import area_query, peers
from quadrille.operators.traversal import prefixed, rim_cells, side
from quadrille.operators.tree import build_tree
from quadrille.sources.points import normal_points, surface_points


def _span(box, top):
    level, *keys = box
    return [(k << (top - level), (k + 1) << (top - level)) for k in keys]


def test_cells_are_looked_up_along_their_rim(spark):
    tree = build_tree(normal_points(spark, 4000, 2), max_particles=4)
    boxes = prefixed(tree.boxes, "t", 2)
    per_key = rim_cells(boxes, "t", "s", 2).groupBy(*side("s", 2)).count()
    assert per_key.where("s_level = 0").collect()[0]["count"] == 1
    assert per_key.agg(F.max("count")).first()[0] < tree.boxes.count() / 4


def test_peers_against_all_pairs(spark):
    tree = build_tree(surface_points(spark, 150, 2), max_particles=6)
    boxes = [tuple(r) for r in tree.boxes.select(*box_names(2)).collect()]
    top = max(b[0] for b in boxes)
    touches = lambda a, b: all(max(p[0], q[0]) <= min(p[1], q[1]) for p, q in zip(_span(a, top), _span(b, top)))
    large = {(t, s) for t, s in itertools.product(boxes, boxes) if s[0] <= t[0] and touches(t, s)}
    want = {(t, s) for t, s in large if not any((t, k) in large for k in boxes if k[0] == s[0] + 1 and (k[1] >> 1, k[2] >> 1) == s[1:])}
    assert {(tuple(r)[:3], tuple(r)[3:]) for r in peers(tree).select(*side("t", 2), *side("s", 2)).collect()} == want


def test_balls_of_all_sizes_against_all_pairs(spark):
    tree = build_tree(surface_points(spark, 400, 2), max_particles=5)
    balls = spark.range(60).select(F.col("id").alias("ball_id"), *[F.rand(seed=i).alias(a) for i, a in enumerate("xy")], F.pow(F.lit(2.0), -(F.col("id") % 12) + 1).alias("radius"))
    want = set()
    for b, r in itertools.product(balls.collect(), tree.leaves().collect()):
        half = tree.width / 2 ** r["level"] / 2
        if max(abs(b[a] - (lo + (r[f"i{a}"] + 0.5) * 2 * half)) for a, lo in zip("xy", tree.lo)) <= b["radius"] + half:
            want.add((b["ball_id"], r["level"], r["ix"], r["iy"]))
    found = [tuple(r) for r in area_query(tree, balls).select("ball_id", *box_names(2)).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert area_query(tree, balls.limit(0)).count() == 0


def test_deep_trees_count_splits_over_blocks_of_levels(spark):
    ends = spark.range(24).select(F.col("id").alias("pid"), F.pow(F.lit(2.0), -F.col("id")).alias("x"), F.pow(F.lit(2.0), -F.col("id")).alias("y"))
    tree = build_tree(ends, max_particles=1)
    leaves = tree.leaves().collect()
    assert max(r["level"] for r in leaves) > 16 and sum(r["n_own"] for r in leaves) == 24 and max(r["n_own"] for r in leaves) == 1


def test_running_sums_and_minima(spark):
    rows = spark.range(500, numPartitions=5).select("id", F.pmod(F.col("id") * 37, F.lit(500)).alias("at"), (F.pmod(F.col("id") * 91, F.lit(23)) - 11).alias("v"))
    inside = sorted(rows.collect(), key=lambda r: r["at"])
    sums = list(itertools.accumulate(r["v"] for r in inside))
    least = list(itertools.accumulate((r["v"] for r in inside), min))
    assert [r["n"] for r in numbered(rows, ["at"], "n", 7).orderBy("at").collect()] == list(range(7, 507))
    summed = running(rows, ["at"], "v", "s")
    assert [r["s"] for r in summed.orderBy("at").collect()] == sums
    assert [r["s"] for r in running(rows, ["at"], "v", "s", how="min").orderBy("at").collect()] == least
    assert numbered(rows.limit(0), ["at"], "n").count() == running(rows.limit(0), ["at"], "v", "s").count() == 0
    assert numbered(rows, ["at"], "n")._jdf.queryExecution().optimizedPlan().toString().count("map(") == 0


def test_running_sums_within_groups_that_span_ranges(spark):
    """One group has most of the rows, so it lies in all ranges; another begins where it ends."""
    rows = [(7 if i % 5 else i, i, i % 11 - 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "g bigint, at bigint, v bigint").repartition(5)
    found = running_within(df, "g", [F.col("at").desc()], {"n": F.lit(1).cast("long"), "total": F.col("v")}).collect()
    sums = {}
    for g, at, v in sorted(rows, key=lambda r: -r[1]):
        n, total = sums.get(g, (0, 0, ()))[:2]
        sums[g] = (n + 1, total + v)
        sums[g, at] = sums[g]
    assert len(found) == len(rows)
    assert all((r["n"], r["total"]) == sums[r["g"], r["at"]] for r in found)
    assert running_within(df.where("g < 0"), "g", ["at"], {"n": F.lit(1)}).count() == 0
