"""The same trees in SQL, written from the definitions, for comparison."""

from __future__ import annotations

POINTS = {
    "orders": "SELECT o_orderkey AS pid, o_totalprice / 500000e0 AS x, o_custkey / 1500e0 AS y, CASE WHEN o_orderkey % 3 = 0 THEN 't' ELSE 's' END AS role, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 17) / 400e0 ELSE 0e0 END AS radius, o_orderkey % 9 + 1 AS weight FROM orders",
    "events_extent": "SELECT event_id AS pid, value / 500e0 AS x, event_id / 10000e0 AS y, CASE WHEN event_id % 3 = 0 THEN 't' ELSE 's' END AS role, CASE WHEN event_id % 3 = 0 THEN (event_id % 17) / 6000e0 ELSE 0e0 END AS radius, 1 AS weight FROM events",
    "events": "SELECT event_id AS pid, value / 500e0 AS x, event_id / 10000e0 AS y, 'b' AS role, 0e0 AS radius, 1 AS weight FROM events",
}
BALLS = "balls AS (SELECT c_custkey AS ball_id, c_acctbal / 11000e0 AS x, c_custkey / 1500e0 AS y, (c_custkey % 13 + 1) / 200e0 AS radius FROM customer)"


def root(points: str = "orders", extent: bool = False) -> str:
    """p: the points; bb: the root box."""
    r = "radius" if extent else "0e0"
    return f"""p AS ({POINTS[points]}),
mm AS (SELECT min(x - {r}) AS x0, max(x + {r}) AS x1, min(y - {r}) AS y0, max(y + {r}) AS y1 FROM p),
bb AS (SELECT x0 AS lx, y0 AS ly, greatest(x1 - x0, y1 - y0) * (1 + 1e-4) AS e FROM mm),
b2 AS (SELECT lx, ly, lx + e AS hx, ly + e AS hy FROM bb)"""


def keys(deepest: int = 12) -> str:
    """k: each point's cell at each level."""
    return f"""k AS (SELECT p.*, l.level, CAST(floor((x - lx) / (hx - lx) * pow(2e0, l.level)) AS BIGINT) AS ix, CAST(floor((y - ly) / (hy - ly) * pow(2e0, l.level)) AS BIGINT) AS iy
FROM p, b2, (SELECT CAST(unnest(range(0, {deepest + 1})) AS INTEGER) AS level) l)"""


def tree(points: str = "orders", limit: int = 32, weight: str = "1", deepest: int = 12) -> str:
    """s: cells that split; kb: a point's boxes; f: its own; box: the boxes with counts."""
    return f"""{root(points)},
{keys(deepest)},
s AS (SELECT level, ix, iy FROM k GROUP BY ALL HAVING sum({weight}) > {limit}),
{BOXES}"""


BOXES = """kb AS (SELECT k.* FROM k WHERE k.level = 0 OR EXISTS (SELECT 1 FROM s WHERE s.level = k.level - 1 AND s.ix = k.ix >> 1 AND s.iy = k.iy >> 1)),
f AS (SELECT pid, max(level) AS level, arg_max(ix, level) AS ix, arg_max(iy, level) AS iy, any_value(x) AS x, any_value(y) AS y, any_value(role) AS role, any_value(radius) AS radius, any_value(weight) AS weight FROM kb GROUP BY pid),
own AS (SELECT level, ix, iy, count(*) AS n_own, count(*) FILTER (role IN ('s', 'b')) AS n_src_own, count(*) FILTER (role IN ('t', 'b')) AS n_tgt_own FROM f GROUP BY ALL),
cum AS (SELECT level, ix, iy, count(*) AS n_cumul, count(*) FILTER (role IN ('s', 'b')) AS n_src_cumul, count(*) FILTER (role IN ('t', 'b')) AS n_tgt_cumul FROM kb GROUP BY ALL),
box AS (SELECT c.level, c.ix, c.iy, coalesce(n_own, 0) AS n_own, coalesce(n_src_own, 0) AS n_src_own, coalesce(n_tgt_own, 0) AS n_tgt_own, n_cumul, n_src_cumul, n_tgt_cumul, s.level IS NOT NULL AS is_split,
 (SELECT coalesce(string_agg(CAST(((c.ix >> (c.level - t.l)) & 1) * 2 + ((c.iy >> (c.level - t.l)) & 1) AS VARCHAR), '' ORDER BY t.l), '') FROM (SELECT unnest(range(1, 13)) AS l) t WHERE t.l <= c.level) AS path
 FROM cum c LEFT JOIN own o ON c.level = o.level AND c.ix = o.ix AND c.iy = o.iy LEFT JOIN s ON c.level = s.level AND c.ix = s.ix AND c.iy = s.iy)"""


def query(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
