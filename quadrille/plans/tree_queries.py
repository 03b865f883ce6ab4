"""Queries on trees over the orders and events tables."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from quadrille.functions.keys import box_names, grid_key, key_names
from quadrille.operators import tree as T
from quadrille.plans import sql
from quadrille.plans.shared import rounded
from quadrille.sources.points import event_points, event_targets, order_points

MAX = 32
BOX = [*box_names(2)]
COUNTS = ["n_own", "n_src_own", "n_tgt_own", "n_cumul", "n_src_cumul", "n_tgt_cumul"]


def orders_tree(spark: SparkSession, sf_dir: str, **more) -> T.Tree:
    """The adaptive tree over orders, at most MAX points a leaf."""
    return T.build_tree(order_points(spark, sf_dir).drop("radius"), max_particles=MAX, **more)


def bbox(spark, sf_dir):
    return T.root_box_row(order_points(spark, sf_dir).drop("radius"), 2)


def level_keys(spark, sf_dir):
    points = order_points(spark, sf_dir).drop("radius")
    lo, hi = T.root_box(*T.bounding_box(points, 2))
    return points.select("pid", *[grid_key(F.col(a), lo[i], hi[i], level).alias(f"i{a}_{level}") for level in (1, 5, 11) for i, a in enumerate("xy")])


def tree_adaptive(spark, sf_dir):
    return orders_tree(spark, sf_dir).boxes.select(*BOX, F.col("n_cumul").alias("n_particles"), (~F.col("is_split")).alias("is_leaf"))


def tree_adaptive_events(spark, sf_dir):
    tree = T.build_tree(event_points(spark, sf_dir), max_particles=MAX)
    return tree.boxes.select(*BOX, F.col("n_cumul").alias("n_particles"), (~F.col("is_split")).alias("is_leaf"))


def tree_weighted(spark, sf_dir):
    tree = T.build_tree(order_points(spark, sf_dir).drop("radius"), max_weight=160)
    return tree.boxes.select(*BOX, F.col("n_cumul").alias("n_particles"), (~F.col("is_split")).alias("is_leaf"))


def tree_nonadaptive(spark, sf_dir):
    tree = T.build_tree(event_points(spark, sf_dir), max_particles=400, kind="non-adaptive")
    return tree.boxes.select(*BOX, F.col("n_cumul").alias("n_particles"), (~F.col("is_split")).alias("is_leaf"))


def tree_unpruned(spark, sf_dir):
    return orders_tree(spark, sf_dir, prune=False).boxes.select(*BOX, F.col("n_cumul").alias("n_particles"), (~F.col("is_split")).alias("is_leaf"))


def tree_level_restricted(spark, sf_dir):
    tree = T.build_tree(event_points(spark, sf_dir), max_particles=MAX, kind="adaptive-level-restricted")
    return tree.boxes.select(*BOX, F.col("n_cumul").alias("n_particles"), (~F.col("is_split")).alias("is_leaf"))


def _extent(spark, sf_dir, norm):
    tree = T.build_tree(order_points(spark, sf_dir), max_particles=MAX, stick_out=0.25, norm=norm)
    return tree.boxes.select(*BOX, "n_own", "n_cumul", (~F.col("is_split")).alias("is_leaf"))


def tree_extent_linf(spark, sf_dir):
    return _extent(spark, sf_dir, "linf")


def tree_extent_l2(spark, sf_dir):
    return _extent(spark, sf_dir, "l2")


def tree_restricted_extent(spark, sf_dir):
    """Level restriction where points with a radius stay above."""
    tree = T.build_tree(event_targets(spark, sf_dir), max_particles=12, kind="adaptive-level-restricted", stick_out=0.25)
    return tree.boxes.select(*BOX, "n_own", "n_cumul", (~F.col("is_split")).alias("is_leaf"))


def tree_user_bbox(spark, sf_dir):
    """In a root box that is given; orders beyond it are in boxes of its size beside it."""
    return orders_tree(spark, sf_dir, bbox=[(-1, 31), (-1, 31)], beyond=True).boxes.select(*BOX, F.col("n_cumul").alias("n_particles"), (~F.col("is_split")).alias("is_leaf"))


def box_ids(spark, sf_dir):
    return T.with_box_ids(orders_tree(spark, sf_dir)).select(*BOX, "path", "box_id")


def tree_order(spark, sf_dir):
    return T.tree_order(orders_tree(spark, sf_dir)).select("pid", "place")


def box_starts(spark, sf_dir):
    return T.box_starts(orders_tree(spark, sf_dir))


def level_starts(spark, sf_dir):
    return T.level_starts(orders_tree(spark, sf_dir))


def src_tgt_counts(spark, sf_dir):
    return orders_tree(spark, sf_dir).boxes.select(*BOX, *COUNTS)


def box_flags(spark, sf_dir):
    return T.flags(orders_tree(spark, sf_dir))


def box_bbox(spark, sf_dir):
    tree = T.build_tree(order_points(spark, sf_dir), max_particles=MAX, stick_out=0.25)
    found = T.box_extents(tree)
    return found.select(*BOX, *[F.round(c, 9).alias(c) for c in found.columns if c not in BOX])


def find_box_for_particle(spark, sf_dir):
    return orders_tree(spark, sf_dir).particles.select("pid", *BOX)


def box_geometry(spark, sf_dir):
    tree = orders_tree(spark, sf_dir)
    level = F.col("level")
    return tree.boxes.select(*BOX, rounded(2 * tree.radius(level), 9).alias("size"), *[rounded(tree.center(i, level, F.col(k)), 9).alias(f"center_{k[1]}") for i, k in enumerate(key_names(2))])


QUERIES = {f.__name__: f for f in (bbox, level_keys, tree_adaptive, tree_adaptive_events, tree_weighted, tree_nonadaptive, tree_unpruned, tree_level_restricted, tree_extent_linf, tree_extent_l2, tree_restricted_extent, tree_user_bbox, box_ids, tree_order, box_starts, level_starts, src_tgt_counts, box_flags, box_bbox, find_box_for_particle, box_geometry)}

_BOXES = "SELECT level, ix, iy, n_cumul AS n_particles, NOT is_split AS is_leaf FROM box"
_FITS = {
    "linf": "greatest(abs(x - cx) + radius - (1 + 0.25e0) * h, abs(y - cy) + radius - (1 + 0.25e0) * h) < 0",
    "l2": "pow(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) + radius, 2) < 2 * pow((1 + 0.25e0) * h, 2)",
}


def extent_tree(norm: str, points: str = "orders", limit: int = MAX) -> str:
    """The tree with point radii: d is the deepest level where a point still fits, at every level before as well."""
    return f"""{sql.root(points, extent=True)},
{sql.keys().replace("k AS", "k0 AS", 1)},
c AS (SELECT k0.*, lx + (ix + 0.5) * ((hx - lx) / pow(2e0, level)) AS cx, ly + (iy + 0.5) * ((hx - lx) / pow(2e0, level)) AS cy, (hx - lx) / pow(2e0, level) / 2 AS h FROM k0, b2),
fit AS (SELECT *, level = 0 OR radius = 0 OR {_FITS[norm]} AS fits FROM c),
bad AS (SELECT pid, min(level) AS first_bad FROM fit WHERE NOT fits GROUP BY pid),
k1 AS (SELECT fit.*, coalesce(first_bad - 1, 99) AS d FROM fit LEFT JOIN bad ON fit.pid = bad.pid),
k AS (SELECT * FROM k1 WHERE level <= d),
s AS (SELECT level, ix, iy FROM k WHERE d > level GROUP BY ALL HAVING count(*) > {limit}),
{sql.BOXES}"""


def _steps(before: str, deepest: int) -> str:
    """s: the boxes s0 that split, with those that must for their neighbours to exist, a level at a time."""
    steps = [f"{before},\nr{deepest} AS (SELECT level, ix, iy FROM s0 WHERE level = {deepest})"]
    for level in range(deepest, 0, -1):
        steps.append(f"r{level - 1} AS (SELECT level, ix, iy FROM s0 WHERE level = {level - 1} UNION SELECT {level - 1}, (ix + dx) >> 1, (iy + dy) >> 1 FROM r{level}, (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b WHERE ix + dx BETWEEN 0 AND (1 << {level}) - 1 AND iy + dy BETWEEN 0 AND (1 << {level}) - 1)")
    steps.append("s AS (" + " UNION ALL ".join(f"SELECT level, ix, iy FROM r{n}" for n in range(deepest + 1)) + ")")
    return ",\n".join([*steps, sql.BOXES])


def _restricted_sql(deepest: int = 12) -> str:
    return _steps(f"{sql.root('events')},\n{sql.keys(deepest)},\ns0 AS (SELECT level, ix, iy FROM k GROUP BY ALL HAVING count(*) > {MAX})", deepest)


def _restricted_extent_sql(deepest: int = 12) -> str:
    before, _ = extent_tree("linf", "events_extent", 12).split(",\ns AS (", 1)
    return _steps(f"{before},\ns0 AS (SELECT level, ix, iy FROM k WHERE d > level GROUP BY ALL HAVING count(*) > 12)", deepest)


_T = sql.tree()
SQL = {
    "bbox": sql.query(sql.root(), "SELECT lx AS lo_x, ly AS lo_y, hx AS hi_x, hy AS hi_y FROM b2"),
    "level_keys": sql.query(sql.root() + ",\n" + sql.keys(), "SELECT pid, " + ", ".join(f"max(CASE WHEN level = {n} THEN i{a} END) AS i{a}_{n}" for n in (1, 5, 11) for a in "xy") + " FROM k GROUP BY pid"),
    "tree_adaptive": sql.query(_T, _BOXES),
    "tree_adaptive_events": sql.query(sql.tree("events"), _BOXES),
    "tree_weighted": sql.query(sql.tree(limit=160, weight="weight"), _BOXES),
    "tree_nonadaptive": sql.query(f"{sql.root('events')},\n{sql.keys()},\nx AS (SELECT level FROM k GROUP BY level, ix, iy HAVING count(*) > 400),\nd AS (SELECT coalesce(max(level) + 1, 0) AS d FROM x)", "SELECT level, ix, iy, count(*) AS n_particles, level = d AS is_leaf FROM k, d WHERE level <= d GROUP BY level, ix, iy, d"),
    "tree_unpruned": sql.query(_T, "SELECT a.level, a.ix, a.iy, coalesce(n_cumul, 0) AS n_particles, s.level IS NULL AS is_leaf FROM (SELECT 0 AS level, 0 AS ix, 0 AS iy UNION ALL SELECT level + 1, ix * 2 + dx, iy * 2 + dy FROM s, (SELECT unnest([0, 1]) AS dx) u, (SELECT unnest([0, 1]) AS dy) v) a LEFT JOIN cum c ON a.level = c.level AND a.ix = c.ix AND a.iy = c.iy LEFT JOIN s ON a.level = s.level AND a.ix = s.ix AND a.iy = s.iy"),
    "tree_level_restricted": sql.query(_restricted_sql(), _BOXES),
    "tree_extent_linf": sql.query(extent_tree("linf"), "SELECT level, ix, iy, n_own, n_cumul, NOT is_split AS is_leaf FROM box"),
    "tree_extent_l2": sql.query(extent_tree("l2"), "SELECT level, ix, iy, n_own, n_cumul, NOT is_split AS is_leaf FROM box"),
    "tree_restricted_extent": sql.query(_restricted_extent_sql(), "SELECT level, ix, iy, n_own, n_cumul, NOT is_split AS is_leaf FROM box"),
    "tree_user_bbox": sql.query(f"p AS ({sql.POINTS['orders']}),\nb2 AS (SELECT -1e0 AS lx, -1e0 AS ly, 31e0 AS hx, 31e0 AS hy),\n{sql.keys()},\ns AS (SELECT level, ix, iy FROM k GROUP BY ALL HAVING count(*) > {MAX}),\n{sql.BOXES}", _BOXES),
    "box_ids": sql.query(_T, "SELECT level, ix, iy, path, row_number() OVER (ORDER BY level, path) - 1 AS box_id FROM box"),
    "tree_order": sql.query(_T, "SELECT f.pid, row_number() OVER (ORDER BY path, CASE WHEN role = 't' THEN 1 ELSE 0 END, pid) - 1 AS place FROM f JOIN box b ON f.level = b.level AND f.ix = b.ix AND f.iy = b.iy"),
    "box_starts": sql.query(_T, "SELECT level, ix, iy, CAST(coalesce(sum(n_own) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n_own, n_cumul FROM box"),
    "level_starts": sql.query(_T, "SELECT level, count(*) AS n_boxes, CAST(sum(count(*)) OVER (ORDER BY level) - count(*) AS BIGINT) AS first_box FROM box GROUP BY level"),
    "src_tgt_counts": sql.query(_T, f"SELECT level, ix, iy, {', '.join(COUNTS)} FROM box"),
    "box_flags": sql.query(_T, "SELECT level, ix, iy, n_src_own > 0 AS is_source, n_tgt_own > 0 AS is_target, is_split AS has_source_child, is_split AS has_target_child, NOT is_split AS is_leaf FROM box"),
    "box_bbox": sql.query(
        extent_tree("linf") + ",\nc2 AS (SELECT box.level, box.ix, box.iy, lx + (ix + 0.5) * ((hx - lx) / pow(2e0, level)) AS cx, ly + (iy + 0.5) * ((hx - lx) / pow(2e0, level)) AS cy FROM box, b2)",
        "SELECT b.level, b.ix, b.iy, round(min(v.x0), 9) AS min_x, round(max(v.x1), 9) AS max_x, round(min(v.y0), 9) AS min_y, round(max(v.y1), 9) AS max_y FROM box b JOIN (SELECT level, ix, iy, x - radius AS x0, x + radius AS x1, y - radius AS y0, y + radius AS y1 FROM f UNION ALL SELECT level, ix, iy, cx, cx, cy, cy FROM c2) v ON v.level >= b.level AND v.ix >> greatest(v.level - b.level, 0) = b.ix AND v.iy >> greatest(v.level - b.level, 0) = b.iy GROUP BY b.level, b.ix, b.iy",
    ),
    "find_box_for_particle": sql.query(_T, "SELECT pid, level, ix, iy FROM f"),
    "box_geometry": sql.query(_T, "SELECT level, ix, iy, round((hx - lx) / pow(2e0, level), 9) AS size, round(lx + (ix + 0.5) * ((hx - lx) / pow(2e0, level)), 9) AS center_x, round(ly + (iy + 0.5) * ((hx - lx) / pow(2e0, level)), 9) AS center_y FROM box, b2"),
}
