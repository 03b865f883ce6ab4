"""Queries on lookups, classes and hierarchical sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import tree as T
from quadrille.operators import classes, fmm, lookup
from quadrille.operators.traversal import Traversal
from quadrille.plans import sql
from quadrille.plans.list_queries import _B, _list2, touch
from quadrille.plans.tree_queries import MAX, orders_tree
from quadrille.sources.points import customer_balls, event_points, order_points

BOX = ["level", "ix", "iy"]


def peers(spark, sf_dir):
    return lookup.peers(T.build_tree(event_points(spark, sf_dir), max_particles=MAX))


def area_query(spark, sf_dir):
    return lookup.area_query(orders_tree(spark, sf_dir), customer_balls(spark, sf_dir)).select("ball_id", *BOX)


def area_query_elementwise(spark, sf_dir):
    """A count and the largest overlap of each ball, from a user's column on the pairs."""
    tree = orders_tree(spark, sf_dir)
    overlap = lambda t: F.col("ball_radius") + t.radius(F.col("level")) - lookup.distance(t)
    pairs = lookup.area_query_elementwise(tree, customer_balls(spark, sf_dir), overlap=overlap)
    return pairs.groupBy("ball_id").agg(F.count(F.lit(1)).alias("n_leaves"), F.round(F.max("overlap"), 9).alias("overlap"))


def leaves_to_balls(spark, sf_dir):
    rows = lookup.leaves_to_balls(orders_tree(spark, sf_dir), customer_balls(spark, sf_dir))
    return rows.select(*BOX, F.array_join("balls", ",").alias("balls"))


def space_invader(spark, sf_dir):
    rows = lookup.space_invader(orders_tree(spark, sf_dir), customer_balls(spark, sf_dir))
    return rows.select(*BOX, F.round("outer_space_invader_dist", 9).alias("outer_space_invader_dist"))


def translation_classes(spark, sf_dir):
    return classes.translation_classes(Traversal(orders_tree(spark, sf_dir)))


def used_translation_classes(spark, sf_dir):
    rows = classes.used_classes(Traversal(orders_tree(spark, sf_dir)))
    return rows.select("class_number", "level", "class_id", "v_x", "v_y", F.round("distance_x", 9).alias("distance_x"), F.round("distance_y", 9).alias("distance_y"))


def class_level_starts(spark, sf_dir):
    return classes.class_level_starts(Traversal(orders_tree(spark, sf_dir)))


def rotation_classes(spark, sf_dir):
    rows = classes.rotation_classes(Traversal(orders_tree(spark, sf_dir)))
    return rows.select("class_number", "class_id", "rotation_class", F.round("angle", 9).alias("angle"))


def fmm_constant_one(spark, sf_dir):
    t = Traversal(orders_tree(spark, sf_dir))
    return fmm.drive(t, fmm.ConstantOne(2)).select("pid", F.col("potential").cast("long").alias("n_seen"))


def fmm_constant_one_events_n2(spark, sf_dir):
    t = Traversal(T.build_tree(event_points(spark, sf_dir), max_particles=MAX), 2)
    return fmm.drive(t, fmm.ConstantOne(2)).select("pid", F.col("potential").cast("long").alias("n_seen"))


def fmm_weighted_sum(spark, sf_dir):
    """With extents, so that all lists take part."""
    points = order_points(spark, sf_dir)
    t = Traversal(T.build_tree(points, max_particles=MAX, stick_out=0.25), 1, "static_linf", 5)
    return fmm.drive(t, fmm.ConstantOne(2), points.select("pid", "weight")).select("pid", F.col("potential").cast("long").alias("weight_seen"))


def direct_laplace_2d(spark, sf_dir):
    """The near field: list 1 only."""
    t = Traversal(orders_tree(spark, sf_dir))
    points = t.tree.particles
    sources = points.where("role = 's'").withColumn("weight", F.lit(1.0))
    value = F.log(fmm.squared_distance(2)) / 2 * fmm.SCALES["laplace", 2]
    return fmm.direct(t.list1, sources, points.where("role = 't'"), 2, value).select("pid", F.round("potential", 6).alias("potential"))


def fmm_laplace_2d(spark, sf_dir):
    """The potential of the first events on all, to a tenth, by expansions of order 16."""
    t = Traversal(T.build_tree(event_points(spark, sf_dir), max_particles=60))
    found = fmm.drive(t, fmm.Laplace2D(t, 16))
    return found.select("pid", F.round("potential", 1).alias("potential"))


def _event_dipoles(spark, sf_dir):
    """Events as sources with a weight and a direction."""
    pid = F.col("pid")
    return event_points(spark, sf_dir).select("pid", ((pid % 3 + 1) / F.lit(2.0)).alias("weight"), ((pid % 7 - 3) / F.lit(1000.0)).alias("dx"), ((pid % 5 - 2) / F.lit(1000.0)).alias("dy"))


def fmm_dipole_2d(spark, sf_dir):
    """The potential of directed sources, through all stages."""
    t = Traversal(T.build_tree(event_points(spark, sf_dir), max_particles=60))
    found = fmm.drive(t, fmm.Laplace2D(t, 24, dipoles=True), _event_dipoles(spark, sf_dir))
    return found.select("pid", F.round("potential", 4).alias("potential"))


def fmm_gradient_2d(spark, sf_dir):
    """Potential and gradient of charges of several strengths; the order grows towards the root."""
    t = Traversal(T.build_tree(event_points(spark, sf_dir), max_particles=60))
    found = fmm.drive(t, fmm.Laplace2D(t, lambda level: 28 if level < 4 else 24, gradient=True), _event_dipoles(spark, sf_dir))
    return found.select("pid", *[F.round(c, 1).alias(c) for c in ("potential", "gradient_x", "gradient_y")])


QUERIES = {f.__name__: f for f in (peers, area_query, area_query_elementwise, leaves_to_balls, space_invader, translation_classes, used_translation_classes, class_level_starts, rotation_classes, fmm_constant_one, fmm_constant_one_events_n2, fmm_weighted_sum, direct_laplace_2d, fmm_laplace_2d, fmm_dipole_2d, fmm_gradient_2d)}

_P, _V = f"{sql.tree()},\n{_B}", f"{sql.tree('events')},\n{_B}"
_PAIRS = f"{_P},\n{sql.BALLS},\nhit AS (SELECT ball_id, b.level, b.ix, b.iy, greatest(abs(a.x - cx), abs(a.y - cy)) AS dist, radius + r AS reach FROM balls a JOIN b ON NOT is_split AND greatest(abs(a.x - cx), abs(a.y - cy)) <= radius + r)"
_CLASS = f"{_P},\nc AS (SELECT *, t_ix - s_ix AS v_x, t_iy - s_iy AS v_y, 3 + t_ix - s_ix + 7 * (3 + t_iy - s_iy) + 49 * t_level AS class_number FROM ({_list2(1)})),\nuc AS (SELECT class_number, t_level AS level, v_x, v_y, row_number() OVER (ORDER BY class_number) - 1 AS class_id FROM (SELECT DISTINCT class_number, t_level, v_x, v_y FROM c))"
_R2 = "((a.x - z.x) * (a.x - z.x) + (a.y - z.y) * (a.y - z.y))"
_DIPOLES = "SELECT event_id AS pid, value / 500e0 AS x, event_id / 10000e0 AS y, (event_id % 3 + 1) / 2e0 AS weight, (event_id % 7 - 3) / 1000e0 AS dx, (event_id % 5 - 2) / 1000e0 AS dy FROM events"
SQL = {
    "peers": sql.query(f"{_V},\nq AS (SELECT DISTINCT t.level AS t_level, t.ix AS t_ix, t.iy AS t_iy, g.l, (t.ix + ox.o) >> (t.level - g.l) AS gx, (t.iy + oy.o) >> (t.level - g.l) AS gy FROM b t JOIN (SELECT unnest(range(13)) AS l) g ON g.l <= t.level CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) ox CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) oy WHERE t.ix + ox.o >= 0 AND t.iy + oy.o >= 0),\nc AS MATERIALIZED (SELECT t_level, t_ix, t_iy, s.level AS s_level, s.ix AS s_ix, s.iy AS s_iy FROM q JOIN b s ON s.level = q.l AND s.ix = q.gx AND s.iy = q.gy)", "SELECT c.* FROM c LEFT JOIN (SELECT DISTINCT c.t_level, c.t_ix, c.t_iy, k.level - 1 AS s_level, k.ix >> 1 AS s_ix, k.iy >> 1 AS s_iy FROM c JOIN b k ON k.level = c.s_level AND k.ix = c.s_ix AND k.iy = c.s_iy WHERE k.level > 0) z ON z.t_level = c.t_level AND z.t_ix = c.t_ix AND z.t_iy = c.t_iy AND z.s_level = c.s_level AND z.s_ix = c.s_ix AND z.s_iy = c.s_iy WHERE z.t_level IS NULL"),
    "area_query": sql.query(_PAIRS, "SELECT ball_id, level, ix, iy FROM hit"),
    "area_query_elementwise": sql.query(_PAIRS, "SELECT ball_id, count(*) AS n_leaves, round(max(reach - dist), 9) AS overlap FROM hit GROUP BY ball_id"),
    "leaves_to_balls": sql.query(_PAIRS, "SELECT level, ix, iy, string_agg(CAST(ball_id AS VARCHAR), ',' ORDER BY ball_id) AS balls FROM hit GROUP BY ALL"),
    "space_invader": sql.query(_PAIRS, "SELECT b.level, b.ix, b.iy, round(coalesce(max(dist), 0e0), 9) AS outer_space_invader_dist FROM b LEFT JOIN hit h ON b.level = h.level AND b.ix = h.ix AND b.iy = h.iy WHERE NOT is_split GROUP BY b.level, b.ix, b.iy"),
    "translation_classes": sql.query(_CLASS, "SELECT t_level, t_ix, t_iy, s_level, s_ix, s_iy, v_x, v_y, class_number FROM c"),
    "used_translation_classes": sql.query(_CLASS, "SELECT class_number, level, class_id, v_x, v_y, round(v_x * ((hx - lx) / pow(2e0, level)), 9) AS distance_x, round(v_y * ((hx - lx) / pow(2e0, level)), 9) AS distance_y FROM uc, b2"),
    "class_level_starts": sql.query(_CLASS, "SELECT level, min(class_id) AS first_class, count(*) AS n_classes FROM uc GROUP BY level"),
    "rotation_classes": sql.query(_CLASS + ",\nr AS (SELECT *, CASE WHEN v_y = 0 THEN 0 ELSE sign(v_y) * (v_y * v_y * 1000000 // (v_x * v_x + v_y * v_y)) END AS a FROM uc),\nm AS (SELECT *, min(class_id) OVER (PARTITION BY a) AS first FROM r)", "SELECT class_number, class_id, dense_rank() OVER (ORDER BY first) - 1 AS rotation_class, round(acos(v_y / sqrt(v_x * v_x + v_y * v_y)), 9) AS angle FROM m"),
    "fmm_constant_one": "SELECT o_orderkey AS pid, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS n_seen FROM orders WHERE o_orderkey % 3 = 0",
    "fmm_constant_one_events_n2": "SELECT event_id AS pid, (SELECT count(*) FROM events) AS n_seen FROM events",
    "fmm_weighted_sum": "SELECT o_orderkey AS pid, CAST((SELECT sum(o_orderkey % 9 + 1) FROM orders WHERE o_orderkey % 3 <> 0) AS BIGINT) AS weight_seen FROM orders WHERE o_orderkey % 3 = 0",
    "direct_laplace_2d": sql.query(_P, f"SELECT a.pid, round(sum(-ln(pow(a.x - z.x, 2) + pow(a.y - z.y, 2)) / (4 * pi())), 6) AS potential FROM f a JOIN b t ON t.level = a.level AND t.ix = a.ix AND t.iy = a.iy JOIN b s ON {touch('t', 's')} AND s.src JOIN f z ON z.level = s.level AND z.ix = s.ix AND z.iy = s.iy AND z.role = 's' WHERE a.role = 't' GROUP BY a.pid"),
    "fmm_laplace_2d": f"WITH p AS ({sql.POINTS['events']}) SELECT a.pid, round(-sum(ln(pow(a.x - z.x, 2) + pow(a.y - z.y, 2)) / 2) / (2 * pi()), 1) AS potential FROM p a JOIN p z ON a.pid <> z.pid GROUP BY a.pid",
    "fmm_dipole_2d": f"WITH p AS ({_DIPOLES}) SELECT a.pid, round(sum(z.weight * (z.dx * (a.x - z.x) + z.dy * (a.y - z.y)) / {_R2}) / (2 * pi()), 4) AS potential FROM p a JOIN p z ON a.pid <> z.pid GROUP BY a.pid",
    "fmm_gradient_2d": f"WITH p AS ({_DIPOLES}) SELECT a.pid, round(-sum(z.weight * ln({_R2}) / 2) / (2 * pi()), 1) AS potential, round(-sum(z.weight * (a.x - z.x) / {_R2}) / (2 * pi()), 1) AS gradient_x, round(-sum(z.weight * (a.y - z.y) / {_R2}) / (2 * pi()), 1) AS gradient_y FROM p a JOIN p z ON a.pid <> z.pid GROUP BY a.pid",
}
