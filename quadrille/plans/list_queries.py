"""Queries on interaction lists; their SQL compares every pair of boxes by the definitions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quadrille.operators import tree as T
from quadrille.operators.traversal import Traversal, csr
from quadrille.plans import sql
from quadrille.plans.tree_queries import MAX, extent_tree, orders_tree
from quadrille.sources.points import event_points, event_targets, order_points

ALPHA, SMALL_ALPHA = 0.25, 0.1


def _plain(spark, sf_dir, name, n=1):
    return getattr(Traversal(orders_tree(spark, sf_dir), n), name)


def _events(spark, sf_dir, name, n=1):
    tree = T.build_tree(event_points(spark, sf_dir), max_particles=MAX)
    return getattr(Traversal(tree, n), name)


def _extent(spark, sf_dir, name, criterion, min_sources=0):
    norm = "l2" if criterion == "static_l2" else "linf"
    tree = T.build_tree(order_points(spark, sf_dir), max_particles=MAX, stick_out=ALPHA, norm=norm)
    return getattr(Traversal(tree, 1, criterion, min_sources), name)


def _event_targets(spark, sf_dir, name):
    """On the events with small radii, whose tree is uneven: lists 3 and 4 and both close lists have edges."""
    tree = T.build_tree(event_targets(spark, sf_dir), max_particles=12, stick_out=SMALL_ALPHA)
    return getattr(Traversal(tree, 1, "static_linf"), name)


def _masked(spark, sf_dir):
    """Sources from boxes with even keys, parents from those where the keys' sum is not a multiple of five."""
    tree = T.build_tree(event_points(spark, sf_dir), max_particles=MAX)
    return Traversal(tree, source_mask=tree.boxes.where("ix % 2 = 0"), source_parent_mask=tree.boxes.where("(ix + iy) % 5 <> 0"))


def list3_masked_parents(spark, sf_dir):
    return _masked(spark, sf_dir).list3


def box_classes_masked(spark, sf_dir):
    t = _masked(spark, sf_dir)
    return t.source_boxes.withColumn("box_class", F.lit("source")).unionByName(t.source_parent_boxes.withColumn("box_class", F.lit("source_parent")))


def box_list(spark, sf_dir):
    """The part of list 1 of the box that holds the first order that is a target."""
    t = Traversal(orders_tree(spark, sf_dir))
    at = t.tree.particles.where("role = 't'").orderBy("pid").select("level", "ix", "iy").first()
    return t.box_list("list1", *at)


def box_classes(spark, sf_dir):
    t = Traversal(orders_tree(spark, sf_dir))
    kinds = {"source": t.source_boxes, "source_parent": t.source_parent_boxes, "target": t.target_boxes, "target_or_parent": t.target_or_target_parent_boxes}
    out = None
    for name, boxes in kinds.items():
        part = boxes.select("*", F.lit(name).alias("box_class"))
        out = part if out is None else out.unionByName(part)
    return out


def list2_arrays(spark, sf_dir):
    rows = csr(Traversal(orders_tree(spark, sf_dir)).list2, 2)
    text = F.transform("sources", lambda s: F.concat_ws(":", s["level"], s["ix"], s["iy"]))
    return rows.select("t_level", "t_ix", "t_iy", F.size("sources").alias("n"), F.array_join(F.array_sort(text), ",").alias("sources"))


PLAIN = [("colleagues_1", "colleagues", 1), ("colleagues_2", "colleagues", 2), ("list1", "list1", 1), ("list2", "list2", 1), ("list2_n2", "list2", 2), ("list4_n2", "list4", 2)]
#: On the events, whose tree is uneven.
EVENTS = [("list1_events", "list1", 1), ("list2_events", "list2", 1), ("list3", "list3", 1), ("list3_n2", "list3", 2), ("list4", "list4", 1), ("list4_events_n2", "list4", 2)]
EXTENT = [(f"{name}_{c}", name, c, 0) for c in ("static_linf", "precise_linf", "static_l2") for name in ("list3", "list3_close")] + [("list3_close_threshold", "list3_close", "static_linf", 20), ("list4_extent", "list4", "static_linf", 0), ("list4_close", "list4_close", "static_linf", 0), ("list1_merged", "list1_merged", "static_linf", 0)]

TARGETS = [("list3_targets", "list3"), ("list3_close_targets", "list3_close"), ("list4_targets", "list4"), ("list4_close_targets", "list4_close")]

QUERIES = {
    "box_classes": box_classes,
    "list2_arrays": list2_arrays,
    "list3_masked_parents": list3_masked_parents,
    "box_classes_masked": box_classes_masked,
    "box_list": box_list,
    **{q: partial(_event_targets, name=name) for q, name in TARGETS},
    **{q: partial(_plain, name=name, n=n) for q, name, n in PLAIN},
    **{q: partial(_events, name=name, n=n) for q, name, n in EVENTS},
    **{q: partial(_extent, name=name, criterion=c, min_sources=k) for q, name, c, k in EXTENT},
}

_B = "b AS (SELECT box.*, n_src_own > 0 AS src, n_tgt_own > 0 AS tgt, ix << (12 - level) AS x0, (ix + 1) << (12 - level) AS x1, iy << (12 - level) AS y0, (iy + 1) << (12 - level) AS y1, 1 << (12 - level) AS w, lx + (ix + 0.5) * ((hx - lx) / pow(2e0, level)) AS cx, ly + (iy + 0.5) * ((hx - lx) / pow(2e0, level)) AS cy, (hx - lx) / pow(2e0, level) / 2 AS r FROM box, b2)"
_EDGE = "t.level AS t_level, t.ix AS t_ix, t.iy AS t_iy, s.level AS s_level, s.ix AS s_ix, s.iy AS s_iy"
EPS = "8 * 2.220446049250313e-16"


def gap(t: str, s: str) -> str:
    return f"greatest(greatest({t}.x0, {s}.x0) - least({t}.x1, {s}.x1), greatest({t}.y0, {s}.y0) - least({t}.y1, {s}.y1))"


def touch(t: str, s: str, n: int = 1) -> str:
    return f"{gap(t, s)} <= {n - 1} * {t}.w"


def coll(a: str, s: str, n: int) -> str:
    """Whether box s is a colleague of the box of level s.level that a is in."""
    up = f"({a}.level - {s}.level)"
    return f"greatest(abs(({a}.ix >> {up}) - {s}.ix), abs(({a}.iy >> {up}) - {s}.iy)) BETWEEN 1 AND {n} AND {s}.level > 0"


def _colleagues(n):
    return f"SELECT {_EDGE} FROM b t JOIN b s ON t.level = s.level AND t.level > 0 AND greatest(abs(t.ix - s.ix), abs(t.iy - s.iy)) BETWEEN 1 AND {n}"


_LIST1 = f"SELECT {_EDGE} FROM b t JOIN b s ON t.tgt AND s.src AND {touch('t', 's')}"


def _list2(n, cols=_EDGE):
    return f"SELECT {cols} FROM b t JOIN b s ON t.level = s.level AND t.level > 0 AND (t.tgt OR t.is_split) AND greatest(abs((t.ix >> 1) - (s.ix >> 1)), abs((t.iy >> 1) - (s.iy >> 1))) BETWEEN 1 AND {n} AND NOT ({touch('t', 's', n)})"


_CRITERION = {
    None: "true",
    "static_linf": f"greatest(0, abs(t.cx - s.cx) - {1 + ALPHA}e0 * t.r - s.r, abs(t.cy - s.cy) - {1 + ALPHA}e0 * t.r - s.r) >= (2 - {EPS}) * s.r",
    "static_l2": f"sqrt(pow(t.cx - s.cx, 2) + pow(t.cy - s.cy, 2)) - sqrt(2e0) * {1 + ALPHA}e0 * t.r - s.r >= (2 - {EPS}) * s.r",
    "precise_linf": f"greatest(0, abs((t.min_x + t.max_x) / 2 - s.cx) - (t.max_x - t.min_x) / 2 - s.r, abs((t.min_y + t.max_y) / 2 - s.cy) - (t.max_y - t.min_y) / 2 - s.r) >= (2 - {EPS}) * s.r",
}
_BOUNDS = """be AS (SELECT b.level, b.ix, b.iy, min(v.x0) AS min_x, max(v.x1) AS max_x, min(v.y0) AS min_y, max(v.y1) AS max_y FROM b JOIN (SELECT level, ix, iy, x - radius AS x0, x + radius AS x1, y - radius AS y0, y + radius AS y1 FROM f WHERE role <> 's' UNION ALL SELECT level, ix, iy, cx, cx, cy, cy FROM b) v
 ON v.level >= b.level AND v.ix >> greatest(v.level - b.level, 0) = b.ix AND v.iy >> greatest(v.level - b.level, 0) = b.iy GROUP BY b.level, b.ix, b.iy),
tb AS (SELECT b.*, min_x, max_x, min_y, max_y FROM b JOIN be ON b.level = be.level AND b.ix = be.ix AND b.iy = be.iy)"""


def _u(n: int, criterion: str | None, least: int, alpha: float = ALPHA) -> str:
    """u: target boxes with every box below a colleague, and whether it is separated."""
    return f"""{_BOUNDS},
u AS (SELECT {_EDGE}, s.src, {touch('t', 's')} AS touch, NOT ({touch('t', 's')}) AND {_CRITERION[criterion].replace(f"{1 + ALPHA}e0", f"{1 + alpha}e0")} AND s.n_src_cumul >= {least} AS ok
 FROM tb t JOIN b s ON t.tgt AND (s.src OR s.is_split) AND s.level > t.level AND t.level > 0 AND greatest(abs((s.ix >> greatest(s.level - t.level, 0)) - t.ix), abs((s.iy >> greatest(s.level - t.level, 0)) - t.iy)) BETWEEN 1 AND {n})"""


_COLUMNS = "u.t_level, u.t_ix, u.t_iy, u.s_level, u.s_ix, u.s_iy"
_SAME_T = "a.t_level = u.t_level AND a.t_ix = u.t_ix AND a.t_iy = u.t_iy"
_LIST3 = f"SELECT {_COLUMNS} FROM u WHERE u.ok AND (u.s_level = u.t_level + 1 OR NOT EXISTS (SELECT 1 FROM u a WHERE {_SAME_T} AND a.s_level = u.s_level - 1 AND a.s_ix = u.s_ix >> 1 AND a.s_iy = u.s_iy >> 1 AND a.ok))"
_CLOSE3 = f"SELECT {_COLUMNS} FROM u LEFT JOIN (SELECT DISTINCT {_COLUMNS} FROM u JOIN u a ON {_SAME_T} AND a.ok AND a.s_level < u.s_level AND a.s_ix = u.s_ix >> greatest(u.s_level - a.s_level, 0) AND a.s_iy = u.s_iy >> greatest(u.s_level - a.s_level, 0)) z ON z.t_level = u.t_level AND z.t_ix = u.t_ix AND z.t_iy = u.t_iy AND z.s_level = u.s_level AND z.s_ix = u.s_ix AND z.s_iy = u.s_iy WHERE u.src AND NOT u.touch AND NOT u.ok AND z.t_level IS NULL"
_FAR = "greatest(abs({p}.cx - s.cx), abs({p}.cy - s.cy)) >= (3 * {a}e0 * {p}.r + s.r) * (1 - {eps})"


def _four(n: int, extent: bool, close: bool, alpha: float = ALPHA) -> str:
    far = lambda p: _FAR.format(p=p, a=1 + alpha, eps=EPS)
    upper = f"(NOT ({touch('p', 's')}) AND ({'true' if n == 1 else 's.level < t.level'}))"
    which = f"NOT {upper}" if not extent else f"NOT ({far('t')}) AND t.tgt" if close else f"({far('t')}) AND (NOT {upper} OR NOT ({far('p')}))"
    return f"SELECT {_EDGE} FROM b t JOIN b p ON p.level = t.level - 1 AND p.ix = t.ix >> 1 AND p.iy = t.iy >> 1 JOIN b s ON s.src AND s.level <= t.level - {1 if n == 1 else 0} AND s.level > 0 AND greatest(abs((t.ix >> greatest(t.level - s.level, 0)) - s.ix), abs((t.iy >> greatest(t.level - s.level, 0)) - s.iy)) BETWEEN 1 AND {n} WHERE (t.tgt OR t.is_split) AND NOT ({touch('t', 's')}) AND {which}"


_P, _V, _E, _L2 = (f"{x},\n{_B}" for x in (sql.tree(), sql.tree("events"), extent_tree("linf"), extent_tree("l2")))


def _extent_sql(name: str, criterion: str, least: int) -> str:
    base = _L2 if criterion == "static_l2" else _E
    if name.startswith("list4"):
        return sql.query(base, _four(1, True, name == "list4_close"))
    u = f"{base},\n{_u(1, criterion, least)}"
    if name == "list1_merged":
        return sql.query(u, f"{_LIST1} UNION ALL {_CLOSE3} UNION ALL {_four(1, True, True)}")
    return sql.query(u, _LIST3 if name == "list3" else _CLOSE3)


_T2 = f"{extent_tree('linf', 'events_extent', 12).replace('0.25e0', f'{SMALL_ALPHA}e0')},\n{_B}"
_MASKS = f"{_V.replace('n_src_own > 0 AS src', 'n_src_own > 0 AND ix % 2 = 0 AS src')},\nnp AS (SELECT level, ix, iy FROM b WHERE (ix + iy) % 5 = 0)"
_TARGETS_SQL = {"list3": _LIST3, "list3_close": _CLOSE3, "list4": _four(1, True, False, SMALL_ALPHA), "list4_close": _four(1, True, True, SMALL_ALPHA)}
_PLAIN_SQL = {"colleagues": _colleagues, "list1": lambda n: _LIST1, "list2": _list2, "list4": lambda n: _four(n, False, False)}
SQL = {
    "box_classes": sql.query(_P, "SELECT level, ix, iy, 'source' AS box_class FROM b WHERE src UNION ALL SELECT level, ix, iy, 'source_parent' FROM b WHERE is_split UNION ALL SELECT level, ix, iy, 'target' FROM b WHERE tgt UNION ALL SELECT level, ix, iy, 'target_or_parent' FROM b WHERE tgt OR is_split"),
    "list2_arrays": sql.query(_P, f"SELECT t_level, t_ix, t_iy, CAST(count(*) AS INTEGER) AS n, string_agg(s, ',' ORDER BY s) AS sources FROM ({_list2(1, 't.level AS t_level, t.ix AS t_ix, t.iy AS t_iy, concat_ws(chr(58), s.level, s.ix, s.iy) AS s')}) GROUP BY t_level, t_ix, t_iy"),
    **{q: sql.query(f"{_T2},\n{_u(1, 'static_linf', 0, SMALL_ALPHA)}" if name.startswith("list3") else _T2, _TARGETS_SQL[name]) for q, name in TARGETS},
    "box_classes_masked": sql.query(_MASKS, "SELECT level, ix, iy, 'source' AS box_class FROM b WHERE src UNION ALL SELECT level, ix, iy, 'source_parent' FROM b WHERE is_split AND (ix + iy) % 5 <> 0"),
    # A box counts if it is a source or a parent itself, and if all boxes from the colleague to its own parent are parents.
    "list3_masked_parents": sql.query(f"{_MASKS},\n{_u(1, None, 0).replace('(s.src OR s.is_split)', '(s.src OR s.is_split AND (s.ix + s.iy) % 5 <> 0)')}", f"SELECT e.* FROM ({_LIST3}) e WHERE NOT EXISTS (SELECT 1 FROM np a WHERE a.level >= e.t_level AND a.level < e.s_level AND a.ix = e.s_ix >> greatest(e.s_level - a.level, 0) AND a.iy = e.s_iy >> greatest(e.s_level - a.level, 0))"),
    "box_list": sql.query(_P, f"SELECT s_level AS level, s_ix AS ix, s_iy AS iy FROM ({_LIST1}) e WHERE (t_level, t_ix, t_iy) = (SELECT (level, ix, iy) FROM f WHERE role = 't' ORDER BY pid LIMIT 1)"),
    **{q: sql.query(_P, _PLAIN_SQL[name](n)) for q, name, n in PLAIN},
    **{q: sql.query(f"{_V},\n{_u(n, None, 0)}", _LIST3) if name == "list3" else sql.query(_V, _PLAIN_SQL[name](n)) for q, name, n in EVENTS},
    **{q: _extent_sql(name, c, k) for q, name, c, k in EXTENT},
}
