"""The plane's expansions against direct sums: charges, dipoles, gradients, orders by level, and list 2 without its edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.keys import box_names
from quadrille.operators import fmm
from quadrille.operators.traversal import Traversal, side
from quadrille.operators.tree import build_tree
from quadrille.sources.points import normal_points, surface_points, uniform_points


def arrays(df, *names):
    rows = df.orderBy("pid").collect()
    return [np.array([r[n] for r in rows], float) for n in names]


def direct(points, sources, dipoles):
    """Potential and gradient at all points, by numpy; sources: pid, weight, dx, dy."""
    pid, x, y = arrays(points, "pid", "x", "y")
    sid, w, dx, dy = arrays(sources, "pid", "weight", "dx", "dy")
    at = np.searchsorted(pid, sid)
    z = (x[:, None] - x[at]) + 1j * (y[:, None] - y[at])
    z[pid[:, None] == sid] = np.nan
    p = -w * (dx + 1j * dy)
    value, slope = (p / z, -p / z**2) if dipoles else (w * np.log(z), w / z)
    total = lambda v: np.nansum(v, 1) / (-2 * math.pi)
    return total(value.real), total(slope.real), total(-slope.imag)


def strengths(points):
    pid = F.col("pid")
    return points.select("pid", ((pid % 4 + 1) / F.lit(2.0)).alias("weight"), ((pid % 7 - 3) / F.lit(3.0)).alias("dx"), ((pid % 5 - 2) / F.lit(3.0)).alias("dy"))


@pytest.mark.parametrize("points,n", [("uniform", 1), ("surface", 1), ("surface", 2)])
@pytest.mark.parametrize("dipoles", [False, True])
def test_potential_and_gradient(spark, points, n, dipoles):
    points = uniform_points(spark, 220, 2) if points == "uniform" else surface_points(spark, 260, 2)
    traversal = Traversal(build_tree(points, max_particles=7), n)
    sources = strengths(points)
    found = fmm.drive(traversal, fmm.Laplace2D(traversal, lambda level: 24 if level < 3 else 20, dipoles, True), sources)
    for got, want in zip(arrays(found, "potential", "gradient_x", "gradient_y"), direct(points, sources, dipoles)):
        assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()


def test_extents_with_list_4(spark):
    """Small targets that stick out, so that lists 3 and 4 and the close lists take part."""
    points = surface_points(spark, 300, 2).withColumn("role", F.when(F.col("pid") % 2 == 0, "t").otherwise("s"))
    points = points.withColumn("radius", F.when(F.col("role") == "t", 0.01 * (F.col("pid") % 5)).otherwise(0.0))
    traversal = Traversal(build_tree(points, max_particles=6, stick_out=0.2), 1, "static_linf")
    sources = strengths(points.where("role = 's'"))
    found = fmm.drive(traversal, fmm.Laplace2D(traversal, 22, True), sources)
    want = direct(points, sources, True)[0][::2]
    assert traversal.list3.take(1) and traversal.list4.take(1)
    assert np.abs(arrays(found, "potential")[0] - want).max() < 1e-5 * np.abs(want).max()


def test_error_bound_on_a_deep_line(spark):
    line = [x for i in range(15) for x in (2.0**-i, 3 - 2.0**-i)]
    rows = [(i, x, 0.0, "s") for i, x in enumerate(line)] + [(100 + i, x * 1.001, 0.0, "t") for i, x in enumerate(line)]
    points = spark.createDataFrame(rows, "pid bigint, x double, y double, role string")
    traversal = Traversal(build_tree(points, max_particles=2))
    assert traversal.tree.boxes.agg(F.max("level")).first()[0] >= 14
    x = np.array(line)
    want = -np.log(np.abs(x[:, None] * 1.001 - x)).sum(1) / (2 * math.pi)
    for order in (35, lambda level: 35 + 3 * (level < 5)):
        got = arrays(fmm.drive(traversal, fmm.Laplace2D(traversal, order)), "potential")[0]
        assert not np.isnan(got).any() and np.abs(got - want).max() / np.abs(want).max() < 0.5**36


@pytest.mark.parametrize("n", [1, 2])
def test_list_2_by_classes_is_that_by_edges(spark, n):
    """Each edge of list 2 by the series themselves, one by one."""
    order = 12
    points = normal_points(spark, 900, 2).withColumn("role", F.when(F.col("x") > -0.4, "t").otherwise("s"))
    traversal = Traversal(build_tree(points, max_particles=9), n)
    kernel, tree = fmm.Laplace2D(traversal, order), traversal.tree
    sources = tree.particles.where("role = 's'").withColumn("weight", F.lit(1.0))
    multipoles = kernel.coarsen_multipoles(kernel.form_multipoles(sources))
    box = lambda r, p: tuple(r[f"{p}{c}"] for c in box_names(2))
    m = {box(r, ""): np.frombuffer(bytes(r["c"]), complex) for r in multipoles.collect()}
    want, choose = {}, [[math.comb(l + k - 1, k - 1) for k in range(1, order + 1)] for l in range(order + 1)]
    k = np.arange(1, order + 1)
    for r in traversal.list2.select(*side("t", 2), *side("s", 2)).collect():
        t, s = box(r, "t_"), box(r, "s_")
        if s not in m:
            continue
        z0, a = complex(s[1] - t[1], s[2] - t[2]), m[s]
        b = np.zeros(order + 1, complex)
        b[0] = a[0] * (np.log(-z0) + math.log(tree.width / 2.0 ** t[0])) + (a[1:] * (-1.0) ** k / z0**k).sum()
        for l in range(1, order + 1):
            b[l] = (-a[0] / l + (a[1:] * (-1.0) ** k / z0**k * choose[l]).sum()) / z0**l
        want[t] = want.get(t, 0) + b
    rows = kernel.multipole_to_local(traversal.list2, multipoles).collect()
    found = {box(r, ""): np.frombuffer(bytes(r["c"]), complex) for r in rows}
    largest = max(np.abs(b).max() for b in want.values())
    assert len(want) > 20 and set(found) == set(want)
    assert max(np.abs(found[t] - want[t]).max() for t in want) < 1e-13 * largest


def test_list_2_sends_less_than_its_edges(spark):
    """A multipole goes to each colleague of its box's parent, in one exchange; by edges it took two."""
    traversal = Traversal(build_tree(uniform_points(spark, 4096, 2), max_particles=6))
    kernel = fmm.Laplace2D(traversal, 4)
    sources = traversal.tree.particles.withColumn("weight", F.lit(1.0))
    multipoles = kernel.coarsen_multipoles(kernel.form_multipoles(sources)).checkpoint()
    plan = kernel.multipole_to_local(traversal.list2, multipoles)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 + plan.count("HashAggregate") // 2  # that of parents with their children is small
    sent = 8 * multipoles.where("level > 1").count()
    assert sent < 0.55 * traversal.list2.count()


def test_sources_need_their_columns(spark):
    traversal = Traversal(build_tree(uniform_points(spark, 30, 2), max_particles=9))
    with pytest.raises(ValueError):
        fmm.drive(traversal, fmm.Laplace2D(traversal, 5, dipoles=True))
    with pytest.raises(ValueError):
        fmm.Laplace2D(traversal, lambda level: level)


def direct_3d(points, sources, dipoles):
    at = np.stack(arrays(points, "x", "y", "z"), 1)
    pid, (sid, w, *along) = arrays(points, "pid")[0], arrays(sources, "pid", "weight", "dx", "dy", "dz")
    apart = at[:, None] - at[np.searchsorted(pid, sid)]
    r = np.sqrt((apart**2).sum(2))
    r[pid[:, None] == sid] = np.nan
    along = np.stack(along, 1)
    dot = (along * apart).sum(2)
    if dipoles:
        value, slope = w * dot / r**3, (w[:, None] * (along - 3 * (dot / r**2)[:, :, None] * apart)) / (r**3)[:, :, None]
    else:
        value, slope = w / r, -w[:, None] * apart / (r**3)[:, :, None]
    return np.nansum(value, 1) / (4 * math.pi), np.nansum(slope, 1) / (4 * math.pi)


@pytest.mark.parametrize("dipoles", [False, True])
def test_space(spark, dipoles):
    points = normal_points(spark, 500, 3)
    traversal = Traversal(build_tree(points, d=3, max_particles=12))
    sources = strengths(points).withColumn("dz", (F.col("pid") % 3 - 1) / F.lit(2.0))
    found = fmm.drive(traversal, fmm.Laplace3D(traversal, lambda level: 15 if level < 3 else 14, dipoles, True), sources)
    value, slope = direct_3d(points, sources, dipoles)
    assert traversal.list2.take(1) and traversal.list3.take(1) and traversal.list4.take(1)
    for got, want in zip(arrays(found, "potential", *[f"gradient_{a}" for a in "xyz"]), (value, *slope.T)):
        assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()


def test_harmonics_of_far_places():
    rng = np.random.default_rng(4)
    far, near_ = rng.normal(size=(20, 3)), rng.normal(size=(20, 3)) * 0.1
    far *= 2 / np.linalg.norm(far, axis=1)[:, None]
    found = (np.conj(fmm.solid_harmonics(near_, 30)) * fmm.singular_harmonics(far, 30)).sum(1)
    assert np.abs(found - 1 / np.linalg.norm(far - near_, axis=1)).max() < 1e-14


def test_near_sums_are_whole_where_they_are_made(spark):
    """Targets are dealt once, by their box: partial sums of a target are not dealt again by its pid."""
    tree = build_tree(uniform_points(spark, 400, 2), max_particles=8)
    t = Traversal(tree)
    points = tree.particles.withColumn("weight", F.lit(1.0))
    value = F.when(fmm.squared_distance(2) > 0, F.lit(1.0)).otherwise(0.0)
    near = fmm.direct(t.list1, points.select("pid", "x", "y", *box_names(2), "weight"), points.select("pid", "x", "y", *box_names(2)), 2, value)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near._jdf.queryExecution().sparkPlan().toString(), near._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan[0] and "Exchange hashpartitioning(pid" not in plan[1]
    assert near.count() == 400


def test_multipoles_are_formed_once(spark, monkeypatch):
    """Every level reads the multipoles of the leaves: they are kept, not formed and dealt again for each."""
    t = Traversal(build_tree(uniform_points(spark, 200, 2), max_particles=8))
    plans, coarsen = [], fmm.Series.coarsen_multipoles

    def spied(self, multipoles):
        plans.append(multipoles._jdf.queryExecution().executedPlan().toString())
        return coarsen(self, multipoles)

    monkeypatch.setattr(fmm.Series, "coarsen_multipoles", spied)
    fmm.drive(t, fmm.Laplace2D(t, 4))
    assert len(plans) == 1 and "MapInArrow" not in plans[0] and "Exchange" not in plans[0]
