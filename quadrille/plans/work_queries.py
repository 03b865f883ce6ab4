"""Queries on linking and filtering, pure boxes, costs, partitions, drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import drawing
from quadrille.operators import boxes as B
from quadrille.operators import cost, partition
from quadrille.operators import fmm
from quadrille.operators import tree as T
from quadrille.operators.traversal import Traversal
from quadrille.plans import sql
from quadrille.plans.list_queries import _CLOSE3, _E, _LIST1, _LIST3, _V, _four, _list2, _u
from quadrille.plans.tree_queries import MAX, orders_tree
from quadrille.sources.points import event_points, line_point_sources, order_points, table

BOX = ["level", "ix", "iy"]
WORKERS = 5


def point_source_links(spark, sf_dir):
    _, counted = T.link_point_sources(orders_tree(spark, sf_dir), line_point_sources(spark, sf_dir), ["line", "part", "supp", "price"])
    return counted


def point_source_order(spark, sf_dir):
    """Places of the first and last point source of each owner."""
    placed, _ = T.link_point_sources(orders_tree(spark, sf_dir), line_point_sources(spark, sf_dir), ["line", "part", "supp", "price"])
    return placed.groupBy("pid").agg(F.min("psid").alias("first"), F.max("psid").alias("last"))


def _flagged(spark, sf_dir):
    return order_points(spark, sf_dir).where("pid % 2 = 0").select("pid")


def filtered_targets_user(spark, sf_dir):
    rows = T.filtered_targets_user_order(orders_tree(spark, sf_dir), _flagged(spark, sf_dir))
    return rows.select(*BOX, F.array_join("targets", ",").alias("targets"))


def filtered_targets_tree(spark, sf_dir):
    return T.filtered_targets_tree_order(orders_tree(spark, sf_dir), _flagged(spark, sf_dir))[1]


def filtered_targets_places(spark, sf_dir):
    return T.filtered_targets_tree_order(orders_tree(spark, sf_dir), _flagged(spark, sf_dir))[0].select("pid", "place")


def _full(spark, sf_dir):
    """The orders' tree with all children, as boxes only, and the number of points of each box."""
    tree = orders_tree(spark, sf_dir, prune=False)
    return B.with_leaves(tree.boxes, 2), tree.boxes.select(*BOX, "n_cumul"), tree


def boxes_uniform(spark, sf_dir):
    return B.refine_uniformly(_full(spark, sf_dir)[0], 2)


def boxes_refine(spark, sf_dir):
    boxes, n, _ = _full(spark, sf_dir)
    return B.refine(boxes, boxes.where("is_leaf").join(n.where("n_cumul >= 20"), BOX), 2)


def boxes_coarsen(spark, sf_dir):
    boxes, n, _ = _full(spark, sf_dir)
    return B.coarsen(boxes, boxes.where("is_leaf").join(n.where("n_cumul < 8"), BOX), 2, error_on_ignored=False)


def boxes_refine_coarsen(spark, sf_dir):
    boxes, n, _ = _full(spark, sf_dir)
    leaves = boxes.where("is_leaf").join(n, BOX)
    return B.refine_and_coarsen(boxes, leaves.where("n_cumul >= 20"), leaves.where("n_cumul < 8"), 2, error_on_ignored=False)


def leaf_vertices(spark, sf_dir):
    boxes, _, tree = _full(spark, sf_dir)
    rows = B.leaf_vertices(boxes, 2, tree.lo, tree.width)
    return rows.select(*BOX, "vertex", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _model(traversal):
    return cost.CostModel(traversal, cost.pde_aware(2, lambda level: 3 + level), cost.unit_parameters() | {"c_p2p": 2.0, "c_m2l": 0.5})


def _events(spark, sf_dir):
    return Traversal(T.build_tree(event_points(spark, sf_dir), max_particles=MAX))


def cost_per_box(spark, sf_dir):
    return _model(_events(spark, sf_dir)).per_box()


def cost_per_box_extent(spark, sf_dir):
    tree = T.build_tree(order_points(spark, sf_dir), max_particles=MAX, stick_out=0.25)
    return _model(Traversal(tree, 1, "static_linf")).per_box()


def cost_per_stage(spark, sf_dir):
    return _model(_events(spark, sf_dir)).per_stage()


def calibration(spark, sf_dir):
    """Lines as timings: price on quantity, by ship mode or return flag."""
    lines = table(spark, sf_dir, "lineitem")
    timings = lines.select(F.col("l_returnflag").alias("stage"), F.col("l_quantity").cast("double").alias("modeled"), F.col("l_extendedprice").cast("double").alias("elapsed"))
    return cost.calibration(timings).select("stage", F.round("parameter", 4).alias("parameter"))


def dfs_order(spark, sf_dir):
    return partition.dfs_order(orders_tree(spark, sf_dir).boxes, 2).select(*BOX, "dfs")


def _ranks(traversal):
    return partition.partition_work(traversal.tree, _model(traversal).per_box(), WORKERS)


def partition_work(spark, sf_dir):
    return _ranks(_events(spark, sf_dir))


def box_masks(spark, sf_dir):
    t = _events(spark, sf_dir)
    return partition.box_masks(t, _ranks(t))


def box_users(spark, sf_dir):
    t = _events(spark, sf_dir)
    rows = partition.box_users(partition.box_masks(t, _ranks(t)), 2)
    return rows.select(*BOX, F.array_join("ranks", ",").alias("ranks"))


def local_particles(spark, sf_dir):
    t = _events(spark, sf_dir)
    return partition.local_particles(t.tree, partition.box_masks(t, _ranks(t))).groupBy("rank", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pid").alias("n_distinct"))


def distributed_constant_one(spark, sf_dir):
    """What each worker's targets see, by worker."""
    t = _events(spark, sf_dir)
    seen = fmm.drive(t, fmm.ConstantOne(2)).join(t.tree.particles.select("pid", *BOX), "pid").join(_ranks(t), BOX)
    return seen.groupBy("rank").agg(F.count(F.lit(1)).alias("n_targets"), F.min("potential").cast("long").alias("least"), F.max("potential").cast("long").alias("most"))


def tikz_lines(spark, sf_dir):
    return drawing.tikz_lines(orders_tree(spark, sf_dir))


def box_labels(spark, sf_dir):
    """Levels in roman numerals and keys in base 2."""
    boxes = orders_tree(spark, sf_dir).boxes
    return boxes.select(*BOX, drawing.roman(F.col("level") + 1).alias("level_name"), drawing.padded_binary(F.col("ix"), 12).alias("ix_bits"))


QUERIES = {
    f.__name__: f
    for f in (point_source_links, point_source_order, filtered_targets_user, filtered_targets_tree, filtered_targets_places, boxes_uniform, boxes_refine, boxes_coarsen, boxes_refine_coarsen, leaf_vertices, cost_per_box, cost_per_box_extent, cost_per_stage, calibration, dfs_order, partition_work, box_masks, box_users, local_particles, distributed_constant_one, tikz_lines, box_labels)
}

_T = sql.tree()
_PATHS = "SELECT f.*, path FROM f JOIN box b ON f.level = b.level AND f.ix = b.ix AND f.iy = b.iy"
_BELOW = "v.level >= b.level AND v.ix >> greatest(v.level - b.level, 0) = b.ix AND v.iy >> greatest(v.level - b.level, 0) = b.iy"


def _counted(own: str, name: str, cumulative: str, start: str) -> str:
    return f"""WITH_OWN AS ({own}),
n1 AS (SELECT b.level, b.ix, b.iy, b.path, coalesce(sum(CASE WHEN v.level = b.level THEN n END), 0) AS own, coalesce(sum(n), 0) AS cum FROM box b LEFT JOIN WITH_OWN v ON {_BELOW} GROUP BY b.level, b.ix, b.iy, b.path)
SELECT level, ix, iy, CAST(coalesce(sum(own) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {start}, CAST(own AS BIGINT) AS {name}, CAST(cum AS BIGINT) AS {cumulative} FROM n1"""


_FULL = f"{_T},\nfull0 AS (SELECT 0 AS level, 0 AS ix, 0 AS iy UNION ALL SELECT level + 1, ix * 2 + dx, iy * 2 + dy FROM s, (SELECT unnest([0, 1]) AS dx) u, (SELECT unnest([0, 1]) AS dy) v),\nfull1 AS (SELECT a.level, a.ix, a.iy, coalesce(c.n_cumul, 0) AS n, s.level IS NULL AS is_leaf FROM full0 a LEFT JOIN cum c ON a.level = c.level AND a.ix = c.ix AND a.iy = c.iy LEFT JOIN s ON a.level = s.level AND a.ix = s.ix AND a.iy = s.iy)"
_KIDS = "(SELECT unnest([0, 1]) AS dx) u, (SELECT unnest([0, 1]) AS dy) v"
_REFINED = f"{_FULL},\nfull2 AS (SELECT level, ix, iy, is_leaf AND n < 20 AS is_leaf, n FROM full1 UNION ALL SELECT level + 1, ix * 2 + dx, iy * 2 + dy, true, -1 FROM full1, {_KIDS} WHERE is_leaf AND n >= 20)"


def _coarse(base: str, t: str) -> str:
    return sql.query(f"{base},\nfam AS (SELECT level - 1 AS level, ix >> 1 AS ix, iy >> 1 AS iy FROM {t} WHERE level > 0 GROUP BY level - 1, ix >> 1, iy >> 1 HAVING bool_and(is_leaf) AND bool_or(is_leaf AND n BETWEEN 0 AND 7))", f"SELECT a.level, a.ix, a.iy, a.is_leaf OR EXISTS (SELECT 1 FROM fam z WHERE z.level = a.level AND z.ix = a.ix AND z.iy = a.iy) AS is_leaf FROM {t} a WHERE NOT EXISTS (SELECT 1 FROM fam z WHERE z.level = a.level - 1 AND z.ix = a.ix >> 1 AND z.iy = a.iy >> 1)")


def _costs(extent: bool) -> str:
    """cost: a row for each box and stage, in the two trees."""
    base = f"{_E},\n{_u(1, 'static_linf', 0)}" if extent else f"{_V},\n{_u(1, None, 0)}"
    near = f"{_LIST1} UNION ALL {_CLOSE3} UNION ALL {_four(1, True, True)}" if extent else _LIST1
    src = "JOIN b s ON s.level = e.s_level AND s.ix = e.s_ix AND s.iy = e.s_iy"
    tgt = "JOIN b t ON t.level = e.t_level AND t.ix = e.t_ix AND t.iy = e.t_iy"
    return f"""{base},
near AS ({near}), l2 AS ({_list2(1)}), l3 AS ({_LIST3}), l4 AS ({_four(1, extent, False)}),
cost AS (SELECT level, ix, iy, 'form_multipoles' AS stage, n_src_own * (4e0 + level) AS c FROM b WHERE src
UNION ALL SELECT e.t_level, e.t_ix, e.t_iy, 'eval_direct', sum(2e0 * t.n_tgt_own * s.n_src_own) FROM near e {src} {tgt} GROUP BY e.t_level, e.t_ix, e.t_iy
UNION ALL SELECT t_level, t_ix, t_iy, 'multipole_to_local', sum(0.5e0 * pow(4e0 + t_level, 2)) FROM l2 GROUP BY t_level, t_ix, t_iy
UNION ALL SELECT e.t_level, e.t_ix, e.t_iy, 'eval_multipoles', sum(t.n_tgt_own * (4e0 + e.s_level)) FROM l3 e {tgt} GROUP BY e.t_level, e.t_ix, e.t_iy
UNION ALL SELECT e.t_level, e.t_ix, e.t_iy, 'form_locals', sum(s.n_src_own * (4e0 + e.s_level)) FROM l4 e {src} GROUP BY e.t_level, e.t_ix, e.t_iy
UNION ALL SELECT level, ix, iy, 'eval_locals', n_tgt_own * (4e0 + level) FROM b WHERE tgt)"""


_COST_BOX = "SELECT b.level, b.ix, b.iy, coalesce(sum(c), 0e0) AS cost FROM b LEFT JOIN cost k ON k.level = b.level AND k.ix = b.ix AND k.iy = b.iy GROUP BY b.level, b.ix, b.iy"
_DFS = "row_number() OVER (ORDER BY translate(path, '0123', '3210')) - 1"
_RANKS = f"""{_costs(False)},
cb AS ({_COST_BOX}),
o AS (SELECT cb.*, {_DFS} AS dfs, sum(cost) OVER (ORDER BY translate(path, '0123', '3210') ROWS UNBOUNDED PRECEDING) AS upto, sum(cost) OVER () AS total FROM cb JOIN box USING (level, ix, iy)),
w AS (SELECT *, CAST((SELECT count(*) FROM (SELECT unnest(range(1, {WORKERS} + 1)) AS k) z WHERE upto > k * total / {WORKERS}) AS BIGINT) AS passed FROM o),
e AS (SELECT *, least(dfs + 1, min(passed - dfs) OVER (ORDER BY dfs) + dfs) AS ended FROM w),
rk AS (SELECT level, ix, iy, dfs, CAST(least(coalesce(lag(ended) OVER (ORDER BY dfs), 0), {WORKERS - 1}) AS INTEGER) AS rank FROM e)"""
_ABOVE = "ab AS (SELECT DISTINCT rank, l AS level, ix >> (level - l) AS ix, iy >> (level - l) AS iy FROM rk, (SELECT CAST(unnest(range(0, 13)) AS INTEGER) AS l) z WHERE l <= level)"


def _of(edges: str, owner: str) -> str:
    return f"SELECT r.rank, e.s_level AS level, e.s_ix AS ix, e.s_iy AS iy FROM {edges} e JOIN {owner} r ON r.level = e.t_level AND r.ix = e.t_ix AND r.iy = e.t_iy"


_MASKS = f"{_RANKS},\n{_ABOVE},\nps AS (SELECT rank, level, ix, iy FROM rk UNION {_of('near', 'rk')} UNION {_of('l4', 'ab')}),\nms AS ({_of('l2', 'ab')} UNION {_of('l3', 'rk')})"
_LINKED = f"ps AS (SELECT l_orderkey AS pid, row_number() OVER (ORDER BY path, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS psid, level, ix, iy FROM lineitem JOIN ({_PATHS}) q ON q.pid = l_orderkey)"
_FILTERED = "SELECT level, ix, iy, count(*) AS n FROM f WHERE role <> 's' AND pid % 2 = 0 GROUP BY ALL"
SQL = {
    "point_source_links": sql.query(f"{_T},\n{_LINKED}", "").rstrip() + ",\n" + _counted("SELECT level, ix, iy, count(*) AS n FROM ps GROUP BY ALL", "n_ps_own", "n_ps_cumul", "ps_start"),
    "point_source_order": sql.query(f"{_T},\n{_LINKED}", "SELECT pid, min(psid) AS first, max(psid) AS last FROM ps GROUP BY pid"),
    "filtered_targets_user": sql.query(_T, "SELECT level, ix, iy, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS targets FROM f WHERE role <> 's' AND pid % 2 = 0 GROUP BY ALL"),
    "filtered_targets_tree": sql.query(_T, "").rstrip() + ",\n" + _counted(_FILTERED, "n_filtered_own", "n_filtered_cumul", "filtered_start"),
    "filtered_targets_places": sql.query(_T, f"SELECT pid, row_number() OVER (ORDER BY path, pid) - 1 AS place FROM ({_PATHS}) q WHERE role <> 's' AND pid % 2 = 0"),
    "boxes_uniform": sql.query(_FULL, f"SELECT level, ix, iy, false AS is_leaf FROM full1 UNION ALL SELECT level + 1, ix * 2 + dx, iy * 2 + dy, true FROM full1, {_KIDS} WHERE is_leaf"),
    "boxes_refine": sql.query(_REFINED, "SELECT level, ix, iy, is_leaf FROM full2"),
    "boxes_coarsen": _coarse(_FULL, "full1"),
    "boxes_refine_coarsen": _coarse(_REFINED, "full2"),
    "leaf_vertices": sql.query(_FULL, f"SELECT level, ix, iy, CAST(dx * 2 + dy AS INTEGER) AS vertex, round(lx + (ix + dx) * ((hx - lx) / pow(2e0, level)), 9) AS x, round(ly + (iy + dy) * ((hx - lx) / pow(2e0, level)), 9) AS y FROM full1, b2, {_KIDS} WHERE is_leaf"),
    "cost_per_box": sql.query(_costs(False), _COST_BOX),
    "cost_per_box_extent": sql.query(_costs(True), _COST_BOX),
    "cost_per_stage": sql.query(_costs(False), "SELECT stage, coalesce(sum(c), 0e0) AS cost FROM (SELECT stage, c FROM cost UNION ALL SELECT 'coarsen_multipoles', (3e0 + level) * (4e0 + level) FROM b WHERE level >= 3 UNION ALL SELECT 'refine_locals', (3e0 + level) * (4e0 + level) FROM b WHERE level >= 1 AND (tgt OR is_split) UNION ALL SELECT unnest(['eval_multipoles', 'form_locals']), 0e0) z GROUP BY stage"),
    "calibration": "SELECT l_returnflag AS stage, round(sum(CAST(l_quantity AS DOUBLE) * CAST(l_extendedprice AS DOUBLE)) / sum(CAST(l_quantity AS DOUBLE) * CAST(l_quantity AS DOUBLE)), 4) AS parameter FROM lineitem GROUP BY l_returnflag",
    "dfs_order": sql.query(_T, f"SELECT level, ix, iy, {_DFS} AS dfs FROM box"),
    "partition_work": sql.query(_RANKS, "SELECT level, ix, iy, dfs, rank FROM rk"),
    "box_masks": sql.query(_MASKS, "SELECT rank, level, ix, iy, 'responsible' AS mask FROM rk UNION ALL SELECT rank, level, ix, iy, 'ancestor' FROM (SELECT rank, level, ix, iy FROM ab EXCEPT SELECT rank, level, ix, iy FROM rk) z UNION ALL SELECT rank, level, ix, iy, 'point_source' FROM ps UNION ALL SELECT rank, level, ix, iy, 'multipole_source' FROM ms"),
    "box_users": sql.query(_MASKS, "SELECT level, ix, iy, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks FROM ms GROUP BY ALL"),
    "local_particles": sql.query(_MASKS, "SELECT rank, kind, count(*) AS n, count(DISTINCT pid) AS n_distinct FROM (SELECT rank, 'source' AS kind, pid FROM f JOIN ps USING (level, ix, iy) WHERE role <> 't' UNION ALL SELECT rank, 'target', pid FROM f JOIN rk USING (level, ix, iy) WHERE role <> 's') z GROUP BY ALL"),
    "distributed_constant_one": sql.query(_RANKS, "SELECT rank, count(*) AS n_targets, (SELECT count(*) FROM events) AS least, (SELECT count(*) FROM events) AS most FROM f JOIN rk USING (level, ix, iy) GROUP BY rank"),
    "tikz_lines": sql.query(_T, "SELECT level, ix, iy, printf('\\draw (%.5f,%.5f) rectangle (%.5f,%.5f);', lx + ix * st, ly + iy * st, lx + (ix + 1) * st, ly + (iy + 1) * st) AS line FROM (SELECT *, (hx - lx) / pow(2e0, level) AS st FROM box, b2) z WHERE NOT is_split"),
    "box_labels": sql.query(_T, "SELECT level, ix, iy, (['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII'])[level + 1] AS level_name, lpad(bin(ix), 12, '0') AS ix_bits FROM box"),
}
