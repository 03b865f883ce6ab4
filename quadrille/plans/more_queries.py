"""Queries on indices, masks, local trees, three dimensions and other kernels."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quadrille.functions import arrays, drawing
from quadrille.functions.keys import box_names
from quadrille.functions.ordering import running
from quadrille.operators import boxes as B
from quadrille.operators import classes, cost, fmm, partition
from quadrille.operators import tree as T
from quadrille.operators.traversal import Traversal
from quadrille.plans import sql
from quadrille.plans.list_queries import SMALL_ALPHA, _B, _LIST1, _LIST3, _colleagues, _four, _list2, _u
from quadrille.plans.tree_queries import orders_tree
from quadrille.plans.work_queries import _KIDS, _MASKS, _counted, _costs, _events, _ranks
from quadrille.sources.points import embedding_points, event_targets, order_points, table

BOX = ["level", "ix", "iy"]
WAVE = 3.0


def source_counter(spark, sf_dir):
    """For each point in tree order the sources before it."""
    tree = orders_tree(spark, sf_dir)
    ordered = T.tree_order(tree).withColumn("_source", F.when(F.col("role") == "s", 1).otherwise(0).cast("long"))
    return running(ordered, ["place"], "_source", "_upto").select("pid", (F.col("_upto") - F.col("_source")).alias("sources_before"))


def source_starts(spark, sf_dir):
    tree = orders_tree(spark, sf_dir)
    own = tree.boxes.where("n_src_own > 0").select(*BOX, F.col("n_src_own").alias("n_source_own"))
    return T._counted(tree, own, "n_source_own", "n_source_cumul", "source_start")


def class_level_boxes(spark, sf_dir):
    """How many boxes of each class there are on a level, and before it."""
    return Traversal(orders_tree(spark, sf_dir)).class_levels().where("box_class <> 'source_parent'")


def reverse_index(spark, sf_dir):
    """From places in tree order back to points."""
    return arrays.reverse_index(T.tree_order(orders_tree(spark, sf_dir)).select("place", "pid"), "place", "pid").select(F.col("place").alias("point"), F.col("pid").alias("at"))


def gappy_copy(spark, sf_dir):
    """Weights of every third place in tree order."""
    tree = orders_tree(spark, sf_dir)
    places = T.tree_order(tree).where("place % 3 = 0").select("place", "pid")
    return arrays.gather(order_points(spark, sf_dir).select("pid", "weight"), places, "pid").select("place", "weight")


def compacted_orders(spark, sf_dir):
    points = order_points(spark, sf_dir)
    return arrays.compacted(points, F.col("weight") > 5, ["pid"], "place").select("pid", "place")


def mask_lists(spark, sf_dir):
    """Which of nine masks an order's weight is in."""
    points = order_points(spark, sf_dir)
    masks = points.select("pid", F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.col("weight") % k == 0).alias("mask"))
    return arrays.mask_lists(masks, "pid", "mask")


def search_sorted(spark, sf_dir):
    """Orders by price among customers' balances."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / F.lit(50.0)).alias("v"))
    customers = table(spark, sf_dir, "customer").select("c_acctbal")
    return arrays.search_sorted(orders, "v", customers, "c_acctbal", "place").select("o_orderkey", "place")


def list1_masked(spark, sf_dir):
    """List 1 where only boxes with even keys may be sources."""
    tree = orders_tree(spark, sf_dir)
    return Traversal(tree, source_mask=tree.boxes.where("ix % 2 = 0 AND iy % 2 = 0")).list1


def local_flags(spark, sf_dir):
    """Of each worker's local tree the target bits, by what it owns."""
    t = _events(spark, sf_dir)
    masks = partition.box_masks(t, _ranks(t))
    known = masks.select("rank", *BOX).distinct()
    own = masks.where("mask = 'responsible'").join(t.tree.boxes.where("n_tgt_own > 0").select(*BOX, "n_tgt_own"), BOX).select("rank", *BOX, "n_tgt_own")
    below = partition.with_ancestors(own.select("rank", *BOX), 2).join(own.select("rank", *BOX), ["rank", *BOX], "left_anti")
    has = lambda df, name: df.select("rank", *BOX, F.lit(True).alias(name)).distinct()
    flagged = known.join(has(own, "is_target"), ["rank", *BOX], "left").join(has(below, "has_target_child"), ["rank", *BOX], "left")
    return flagged.fillna(False, ["is_target", "has_target_child"])


def cost_per_stage_taylor(spark, sf_dir):
    t = _events(spark, sf_dir)
    return cost.CostModel(t, cost.taylor(2, lambda level: 2)).per_stage()


def tree_3d(spark, sf_dir):
    tree = T.build_tree(embedding_points(spark, sf_dir), d=3, max_particles=20)
    return tree.boxes.select(*box_names(3), F.col("n_cumul").alias("n_particles"), (~F.col("is_split")).alias("is_leaf"))


def fmm_constant_one_3d(spark, sf_dir):
    t = Traversal(T.build_tree(embedding_points(spark, sf_dir), d=3, max_particles=20))
    return fmm.drive(t, fmm.ConstantOne(3)).select("pid", F.col("potential").cast("long").alias("n_seen"))


def _near(spark, sf_dir):
    t = Traversal(orders_tree(spark, sf_dir))
    points = t.tree.particles
    return t.list1, points.where("role = 's'").withColumn("weight", F.lit(1.0)), points.where("role = 't'")


def direct_gradient_2d(spark, sf_dir):
    """The gradient of the near field."""
    edges, sources, targets = _near(spark, sf_dir)
    parts = [fmm.direct(edges, sources, targets, 2, (F.col(f"t_{a}") - F.col(f"s_{a}")) / fmm.squared_distance(2) * fmm.SCALES["laplace", 2]).select("pid", F.round("potential", 6).alias(f"gradient_{a}")) for a in "xy"]
    return parts[0].join(parts[1], "pid")


def direct_dipole_2d(spark, sf_dir):
    """The near field of dipoles along the first axis."""
    edges, sources, targets = _near(spark, sf_dir)
    return fmm.direct(edges, sources, targets, 2, (F.col("s_x") - F.col("t_x")) / fmm.squared_distance(2) * fmm.SCALES["laplace", 2]).select("pid", F.round("potential", 6).alias("potential"))


def _near_3d(spark, sf_dir):
    t = Traversal(T.build_tree(embedding_points(spark, sf_dir), d=3, max_particles=20))
    return t.list1, t.tree.particles.withColumn("weight", F.lit(1.0)), t.tree.particles


def direct_laplace_3d(spark, sf_dir):
    edges, sources, targets = _near_3d(spark, sf_dir)
    return fmm.direct(edges, sources, targets, 3, fmm.SCALES["laplace", 3] / F.sqrt(fmm.squared_distance(3))).select("pid", F.round("potential", 6).alias("potential"))


def direct_helmholtz_3d(spark, sf_dir):
    edges, sources, targets = _near_3d(spark, sf_dir)
    r = F.sqrt(fmm.squared_distance(3))
    parts = [fmm.direct(edges, sources, targets, 3, f(WAVE * r) / r * fmm.SCALES["helmholtz", 3]).select("pid", F.round("potential", 6).alias(name)) for f, name in ((F.cos, "real"), (F.sin, "imaginary"))]
    return parts[0].join(parts[1], "pid")


def _space(spark, sf_dir):
    return Traversal(T.build_tree(embedding_points(spark, sf_dir), d=3, max_particles=20))


def rotation_classes_3d(spark, sf_dir):
    rows = classes.rotation_classes(_space(spark, sf_dir))
    return rows.select("class_number", "class_id", "rotation_class", F.round("angle", 9).alias("angle"))


def cost_m2l_3d(spark, sf_dir):
    """List 2 in space, where expansions are turned to an axis, moved and turned back."""
    model = cost.CostModel(_space(spark, sf_dir), cost.pde_aware(3, lambda level: 2 + level))
    return model.multipole_to_local().select(*box_names(3), F.round("cost", 6).alias("cost"))


def fmm_laplace_3d(spark, sf_dir):
    """The potential of all on all in space."""
    t = _space(spark, sf_dir)
    return fmm.drive(t, fmm.Laplace3D(t, 16)).select("pid", F.round("potential", 2).alias("potential"))


def fmm_dipole_3d(spark, sf_dir):
    """The potential of directed sources in space."""
    t, pid = _space(spark, sf_dir), F.col("pid")
    along = {"weight": (pid % 3 + 1) / F.lit(2.0), "dx": (pid % 7 - 3) / F.lit(10.0), "dy": (pid % 5 - 2) / F.lit(10.0), "dz": (pid % 3 - 1) / F.lit(10.0)}
    found = fmm.drive(t, fmm.Laplace3D(t, 16, dipoles=True), t.tree.particles.select("pid", *[c.alias(n) for n, c in along.items()]))
    return found.select("pid", F.round("potential", 1).alias("potential"))


def box_list_lines(spark, sf_dir):
    """TikZ for the part of list 2 of the box that is above the first order, three levels down from the root."""
    t = Traversal(orders_tree(spark, sf_dir))
    at = t.tree.particles.orderBy("pid").select(F.lit(3), *[F.call_function("shiftright", F.col(k), F.col("level") - 3) for k in ("ix", "iy")]).first()
    return drawing.filled_lines(t.tree, t.box_list("list2", *at), "blue!20")


def fmm_weighted_sum_events(spark, sf_dir):
    """With lists 3 and 4 and both close lists."""
    points = event_targets(spark, sf_dir)
    t = Traversal(T.build_tree(points, max_particles=12, stick_out=SMALL_ALPHA), 1, "static_linf")
    seen = fmm.drive(t, fmm.ConstantOne(2), points.select("pid", (F.col("pid") % 7 + 1).alias("weight")))
    return seen.select("pid", F.col("potential").cast("long").alias("weight_seen"))


#: The root box of the boxes alone; lists do not depend on it.
UNIT = [(0.0, 1.0), (0.0, 1.0)]


def _refined_boxes(spark, sf_dir):
    """A tree of boxes alone: that of the orders, where the fuller leaves are refined and the emptier ones removed."""
    tree = T.build_tree(order_points(spark, sf_dir).drop("radius"), max_particles=256, prune=False)
    boxes = B.with_leaves(tree.boxes, 2)
    leaves = boxes.where("is_leaf").join(tree.boxes.select(*BOX, "n_cumul"), BOX)
    return B.refine_and_coarsen(boxes, leaves.where("n_cumul >= 150"), leaves.where("n_cumul < 40"), 2, error_on_ignored=False)


def boxes_level_ids(spark, sf_dir):
    return B.with_ids(_refined_boxes(spark, sf_dir), 2)


def _boxes_list(spark, sf_dir, name):
    return getattr(Traversal(B.as_tree(_refined_boxes(spark, sf_dir), 2, UNIT)), name)


BOXES_LISTS = [(f"boxes_{name}", name) for name in ("colleagues", "list1", "list2", "list3", "list4")]
QUERIES = {q: partial(_boxes_list, name=name) for q, name in BOXES_LISTS} | {
    f.__name__: f
    for f in (fmm_laplace_3d, fmm_dipole_3d, rotation_classes_3d, cost_m2l_3d, box_list_lines, fmm_weighted_sum_events, boxes_level_ids, source_counter, source_starts, class_level_boxes, reverse_index, gappy_copy, compacted_orders, mask_lists, search_sorted, list1_masked, local_flags, cost_per_stage_taylor, tree_3d, fmm_constant_one_3d, direct_gradient_2d, direct_dipole_2d, direct_laplace_3d, direct_helmholtz_3d)
}

_T = sql.tree()
_P = f"{_T},\n{_B}"
_ORDER = "SELECT f.*, row_number() OVER (ORDER BY path, CASE WHEN role = 't' THEN 1 ELSE 0 END, pid) - 1 AS place FROM f JOIN box b ON f.level = b.level AND f.ix = b.ix AND f.iy = b.iy"
_NEAR = "FROM f a JOIN b t ON t.level = a.level AND t.ix = a.ix AND t.iy = a.iy JOIN l1 e ON e.t_level = t.level AND e.t_ix = t.ix AND e.t_iy = t.iy JOIN f z ON z.level = e.s_level AND z.ix = e.s_ix AND z.iy = e.s_iy AND z.role = 's' WHERE a.role = 't' GROUP BY a.pid"
_R2 = "(pow(a.x - z.x, 2) + pow(a.y - z.y, 2))"
_SPACE = """p AS (SELECT vec_id AS pid, CAST({c}[1] AS DOUBLE) AS x, CAST({c}[2] AS DOUBLE) AS y, CAST({c}[3] AS DOUBLE) AS z FROM embeddings),
mm AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) * (1 + 1e-4) AS e FROM p),
k AS (SELECT p.*, level, CAST(floor((x - lx) / (lx + e - lx) * pow(2e0, level)) AS BIGINT) AS ix, CAST(floor((y - ly) / (ly + e - ly) * pow(2e0, level)) AS BIGINT) AS iy, CAST(floor((z - lz) / (lz + e - lz) * pow(2e0, level)) AS BIGINT) AS iz FROM p, mm, (SELECT CAST(unnest(range(0, 13)) AS INTEGER) AS level) l),
s AS (SELECT level, ix, iy, iz FROM k GROUP BY ALL HAVING count(*) > 20),
kb AS (SELECT k.* FROM k WHERE k.level = 0 OR EXISTS (SELECT 1 FROM s WHERE s.level = k.level - 1 AND s.ix = k.ix >> 1 AND s.iy = k.iy >> 1 AND s.iz = k.iz >> 1)),
f AS (SELECT pid, max(level) AS level, arg_max(ix, level) AS ix, arg_max(iy, level) AS iy, arg_max(iz, level) AS iz, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM kb GROUP BY pid)""".format(c="embedding")
_TOUCH3 = " AND ".join(f"greatest(a.i{x} << (12 - a.level), b.i{x} << (12 - b.level)) <= least((a.i{x} + 1) << (12 - a.level), (b.i{x} + 1) << (12 - b.level))" for x in "xyz")
_R3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
_POINTS3 = "SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"
_BOX3 = f"{_SPACE},\nbx AS (SELECT DISTINCT level, ix, iy, iz FROM kb),\nl2 AS (SELECT t.level, t.ix, t.iy, t.iz, t.ix - s.ix AS vx, t.iy - s.iy AS vy, t.iz - s.iz AS vz FROM bx t JOIN bx s ON t.level = s.level AND t.level > 0 AND greatest(abs((t.ix >> 1) - (s.ix >> 1)), abs((t.iy >> 1) - (s.iy >> 1)), abs((t.iz >> 1) - (s.iz >> 1))) = 1 AND greatest(abs(t.ix - s.ix), abs(t.iy - s.iy), abs(t.iz - s.iz)) > 1)"
_BOXES = f"""{sql.tree(limit=256)},
full0 AS (SELECT 0 AS level, 0 AS ix, 0 AS iy UNION ALL SELECT level + 1, ix * 2 + dx, iy * 2 + dy FROM s, {_KIDS}),
full1 AS (SELECT a.level, a.ix, a.iy, coalesce(c.n_cumul, 0) AS n, s.level IS NULL AS is_leaf FROM full0 a LEFT JOIN cum c ON a.level = c.level AND a.ix = c.ix AND a.iy = c.iy LEFT JOIN s ON a.level = s.level AND a.ix = s.ix AND a.iy = s.iy),
full2 AS (SELECT level, ix, iy, is_leaf AND n < 150 AS is_leaf, n FROM full1 UNION ALL SELECT level + 1, ix * 2 + dx, iy * 2 + dy, true, -1 FROM full1, {_KIDS} WHERE is_leaf AND n >= 150),
fam AS (SELECT level - 1 AS level, ix >> 1 AS ix, iy >> 1 AS iy FROM full2 WHERE level > 0 GROUP BY level - 1, ix >> 1, iy >> 1 HAVING bool_and(is_leaf) AND bool_or(is_leaf AND n BETWEEN 0 AND 39)),
full3 AS (SELECT a.level, a.ix, a.iy, a.is_leaf OR EXISTS (SELECT 1 FROM fam z WHERE z.level = a.level AND z.ix = a.ix AND z.iy = a.iy) AS is_leaf FROM full2 a WHERE NOT EXISTS (SELECT 1 FROM fam z WHERE z.level = a.level - 1 AND z.ix = a.ix >> 1 AND z.iy = a.iy >> 1)),
b AS (SELECT level, ix, iy, NOT is_leaf AS is_split, true AS src, true AS tgt, 1 AS n_src_cumul, ix << (12 - level) AS x0, (ix + 1) << (12 - level) AS x1, iy << (12 - level) AS y0, (iy + 1) << (12 - level) AS y1, 1 << (12 - level) AS w FROM full3),
f AS (SELECT 's' AS role, 0 AS level, 0 AS ix, 0 AS iy, 0e0 AS x, 0e0 AS y, 0e0 AS radius WHERE false)"""
_BOXES = _BOXES.replace(",\nf AS (SELECT pid", ",\nf0 AS (SELECT pid").replace("FROM f GROUP BY ALL),\ncum", "FROM f0 GROUP BY ALL),\ncum")
_U = _u(1, None, 0)
_BOXES_U = f"{_BOXES},\n" + _U[_U.index("u AS ("):].replace("FROM tb t", "FROM b t")
_LISTS = {"colleagues": (_BOXES, _colleagues(1)), "list1": (_BOXES, _LIST1), "list2": (_BOXES, _list2(1)), "list3": (_BOXES_U, _LIST3), "list4": (_BOXES, _four(1, False, False))}
SQL = {
    **{q: sql.query(*_LISTS[name]) for q, name in BOXES_LISTS},
    "boxes_level_ids": sql.query(_BOXES, "SELECT level, ix, iy, is_leaf, row_number() OVER (ORDER BY level, path) - 1 AS box_id FROM (SELECT full3.*, (SELECT coalesce(string_agg(CAST(((full3.ix >> (full3.level - t.l)) & 1) * 2 + ((full3.iy >> (full3.level - t.l)) & 1) AS VARCHAR), '' ORDER BY t.l), '') FROM (SELECT unnest(range(1, 13)) AS l) t WHERE t.l <= full3.level) AS path FROM full3) z"),
    "fmm_laplace_3d": f"WITH p AS ({_POINTS3}) SELECT a.pid, round(sum(1 / {_R3}) / (4 * pi()), 2) AS potential FROM p a JOIN p b ON a.pid <> b.pid GROUP BY a.pid",
    "fmm_dipole_3d": f"WITH p AS (SELECT *, (pid % 3 + 1) / 2e0 AS w, (pid % 7 - 3) / 10e0 AS dx, (pid % 5 - 2) / 10e0 AS dy, (pid % 3 - 1) / 10e0 AS dz FROM ({_POINTS3}) q),\ne AS (SELECT a.pid, w, dx, dy, dz, a.x - b.x AS x, a.y - b.y AS y, a.z - b.z AS z, {_R3} AS r FROM (SELECT pid, x, y, z FROM p) a JOIN p b ON a.pid <> b.pid),\nd AS (SELECT *, dx * x + dy * y + dz * z AS dot FROM e)\nSELECT pid, round(sum(w * dot / pow(r, 3)) / (4 * pi()), 1) AS potential FROM d GROUP BY pid",
    "rotation_classes_3d": sql.query(f"{_BOX3},\nuc AS (SELECT *, row_number() OVER (ORDER BY class_number) - 1 AS class_id, CASE WHEN vz = 0 THEN 0 ELSE sign(vz) * (vz * vz * 1000000 // (vx * vx + vy * vy + vz * vz)) END AS a FROM (SELECT DISTINCT 3 + vx + 7 * (3 + vy) + 49 * (3 + vz) + 343 * level AS class_number, vx, vy, vz FROM l2) z),\nm AS (SELECT *, min(class_id) OVER (PARTITION BY a) AS first FROM uc)", "SELECT class_number, class_id, dense_rank() OVER (ORDER BY first) - 1 AS rotation_class, round(acos(vz / sqrt(vx * vx + vy * vy + vz * vz)), 9) AS angle FROM m"),
    "cost_m2l_3d": sql.query(_BOX3, "SELECT level, ix, iy, iz, round(count(*) * 3 * pow(3e0 + level, 3), 6) AS cost FROM l2 GROUP BY level, ix, iy, iz"),
    "box_list_lines": sql.query(f"{_P},\na AS (SELECT ix >> (level - 3) AS ix, iy >> (level - 3) AS iy FROM f ORDER BY pid LIMIT 1)", f"SELECT s_level AS level, s_ix AS ix, s_iy AS iy, printf('\\fill[blue!20] (%.5f,%.5f) rectangle (%.5f,%.5f);', lx + s_ix * st, ly + s_iy * st, lx + (s_ix + 1) * st, ly + (s_iy + 1) * st) AS line FROM ({_list2(1)}) e JOIN a ON t_level = 3 AND t_ix = a.ix AND t_iy = a.iy, (SELECT *, (hx - lx) / 8 AS st FROM b2) z"),
    "fmm_weighted_sum_events": "SELECT event_id AS pid, CAST((SELECT sum(event_id % 7 + 1) FROM events WHERE event_id % 3 <> 0) AS BIGINT) AS weight_seen FROM events WHERE event_id % 3 = 0",
    "source_counter": sql.query(f"{_T},\no AS ({_ORDER})", "SELECT pid, CAST(coalesce(sum(CASE WHEN role = 's' THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sources_before FROM o"),
    "source_starts": sql.query(_T, "").rstrip() + ",\n" + _counted("SELECT level, ix, iy, count(*) AS n FROM f WHERE role = 's' GROUP BY ALL", "n_source_own", "n_source_cumul", "source_start"),
    "class_level_boxes": sql.query(f"{_P},\nc AS (SELECT level, 'source' AS box_class FROM b WHERE src UNION ALL SELECT level, 'target' FROM b WHERE tgt UNION ALL SELECT level, 'target_or_parent' FROM b WHERE tgt OR is_split)", "SELECT box_class, level, count(*) AS n_boxes, CAST(sum(count(*)) OVER (PARTITION BY box_class ORDER BY level) - count(*) AS BIGINT) AS first FROM c GROUP BY box_class, level"),
    "reverse_index": sql.query(f"{_T},\no AS ({_ORDER})", "SELECT pid AS point, place AS at FROM o"),
    "gappy_copy": sql.query(f"{_T},\no AS ({_ORDER})", "SELECT place, weight FROM o WHERE place % 3 = 0"),
    "compacted_orders": f"SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS place FROM ({sql.POINTS['orders']}) WHERE weight > 5",
    "mask_lists": f"SELECT pid, CAST(k - 1 AS INTEGER) AS place FROM ({sql.POINTS['orders']}), (SELECT unnest(range(1, 10)) AS k) z WHERE weight % k = 0",
    "search_sorted": "SELECT o_orderkey, (SELECT count(*) FROM customer WHERE c_acctbal <= o_totalprice / 50e0) - 1 AS place FROM orders",
    "list1_masked": sql.query(_P, f"SELECT * FROM ({_LIST1}) e WHERE s_ix % 2 = 0 AND s_iy % 2 = 0"),
    "local_flags": sql.query(f"{_MASKS},\nkn AS (SELECT rank, level, ix, iy FROM rk UNION SELECT rank, level, ix, iy FROM ab UNION SELECT rank, level, ix, iy FROM ps UNION SELECT rank, level, ix, iy FROM ms),\now AS (SELECT rk.rank, level, ix, iy FROM rk JOIN b USING (level, ix, iy) WHERE tgt)", "SELECT k.rank, k.level, k.ix, k.iy, coalesce(bool_or(o.level = k.level), false) AS is_target, coalesce(bool_or(o.level > k.level), false) AS has_target_child FROM kn k LEFT JOIN ow o ON o.rank = k.rank AND o.level >= k.level AND o.ix >> greatest(o.level - k.level, 0) = k.ix AND o.iy >> greatest(o.level - k.level, 0) = k.iy GROUP BY k.rank, k.level, k.ix, k.iy"),
    "cost_per_stage_taylor": sql.query(_costs(False), "SELECT stage, coalesce(sum(c), 0e0) AS cost FROM (SELECT 'form_multipoles' AS stage, n_src_own * 9e0 AS c FROM b UNION ALL SELECT 'eval_direct', c / 2e0 FROM cost WHERE stage = 'eval_direct' UNION ALL SELECT 'multipole_to_local', 81e0 FROM l2 UNION ALL SELECT 'eval_multipoles', t.n_tgt_own * 9e0 FROM l3 e JOIN b t ON t.level = e.t_level AND t.ix = e.t_ix AND t.iy = e.t_iy UNION ALL SELECT 'form_locals', s.n_src_own * 9e0 FROM l4 e JOIN b s ON s.level = e.s_level AND s.ix = e.s_ix AND s.iy = e.s_iy UNION ALL SELECT 'eval_locals', n_tgt_own * 9e0 FROM b UNION ALL SELECT 'coarsen_multipoles', 81e0 FROM b WHERE level >= 3 UNION ALL SELECT 'refine_locals', 81e0 FROM b WHERE level >= 1 AND (tgt OR is_split) UNION ALL SELECT unnest(['eval_multipoles', 'form_locals', 'coarsen_multipoles']), 0e0) z GROUP BY stage"),
    "tree_3d": sql.query(_SPACE, "SELECT kb.level, kb.ix, kb.iy, kb.iz, count(*) AS n_particles, count(*) <= 20 AS is_leaf FROM kb GROUP BY kb.level, kb.ix, kb.iy, kb.iz"),
    "fmm_constant_one_3d": "SELECT vec_id AS pid, (SELECT count(*) FROM embeddings) AS n_seen FROM embeddings",
    "direct_gradient_2d": sql.query(f"{_P},\nl1 AS ({_LIST1})", f"SELECT a.pid, round(sum(-(a.x - z.x) / {_R2} / (2 * pi())), 6) AS gradient_x, round(sum(-(a.y - z.y) / {_R2} / (2 * pi())), 6) AS gradient_y {_NEAR}"),
    "direct_dipole_2d": sql.query(f"{_P},\nl1 AS ({_LIST1})", f"SELECT a.pid, round(sum((a.x - z.x) / {_R2} / (2 * pi())), 6) AS potential {_NEAR}"),
    "direct_laplace_3d": sql.query(_SPACE, f"SELECT a.pid, round(sum(1 / {_R3} / (4 * pi())), 6) AS potential FROM f a JOIN f b ON a.pid <> b.pid AND {_TOUCH3} GROUP BY a.pid"),
    "direct_helmholtz_3d": sql.query(_SPACE, f"SELECT a.pid, round(sum(cos(3e0 * {_R3}) / {_R3} / (4 * pi())), 6) AS real, round(sum(sin(3e0 * {_R3}) / {_R3} / (4 * pi())), 6) AS imaginary FROM f a JOIN f b ON a.pid <> b.pid AND {_TOUCH3} GROUP BY a.pid"),
}
