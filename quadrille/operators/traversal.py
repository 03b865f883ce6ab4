"""Interaction lists of a tree, as tables of (target box, source box) edges.

Edges have the columns t_level, t_ix, ... and s_level, s_ix, ... Every list is made by
equi-joins on box keys: the boxes that may stand in a relation to a box are computed
from its keys (neighbours, their parents or children) and looked up. What can be told
from keys alone is decided before the join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.functions.keys import axes, block, box_names, inside, key_names, levels, moved, offsets, shift, within
from quadrille.operators.tree import Tree, box_extents
from quadrille.plans.shared import cut

CRITERIA = ("static_linf", "precise_linf", "static_l2")
#: The slack of the separation criteria, in units of the machine's epsilon.
SLACK = 8 * 2.0**-52


def side(prefix: str, d: int) -> list[str]:
    return [f"{prefix}_{c}" for c in box_names(d)]


def prefixed(boxes: DataFrame, prefix: str, d: int, *more: str) -> DataFrame:
    """The boxes' keys, and more columns, with a prefix."""
    return boxes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in (*box_names(d), *more)])


def near(prefix: str, d: int, n: int) -> Column:
    """Whether box s is within n - 1 widths of t of box t, for edges with t_ and s_ columns; prefix names the t side."""
    keys = lambda p: [F.col(f"{p}_{k}") for k in key_names(d)]
    return within(F.col(f"{prefix}_level"), keys(prefix), F.col("s_level"), keys("s"), n)


def rim_cells(fine: DataFrame, f: str, c: str, d: int, own: tuple[int, ...] = ()) -> DataFrame:
    """The boxes fine (with columns prefixed by f), each with the cells (prefixed by c) of its own level and above
    that hold it or touch it. Larger cells that hold it are left out but for the levels own."""
    names = key_names(d)
    at = F.explode(levels(0, F.col(f"{f}_level"))).alias(f"{c}_level")
    up = F.col(f"{f}_level") - F.col(f"{c}_level")
    cell = lambda move: F.struct(*[shift(F.col(f"{f}_{k}") + o, up).alias(f"{c}_{k}") for k, o in zip(names, move)])
    cells = F.array_distinct(F.array(*[cell(move) for move in offsets(d, 1, zero=True)]))
    whole = (up == 0) | F.col(f"{c}_level").isin(*own) if own else up == 0
    cells = F.when(whole, cells).otherwise(F.array_remove(cells, cell([0] * d)))
    probes = fine.select("*", at).select("*", F.explode(cells).alias("_cell")).select(*fine.columns, f"{c}_level", "_cell.*")
    return probes.where(inside_of(c, d))


def touching(fine: DataFrame, f: str, coarse: DataFrame, c: str, d: int, own: tuple[int, ...] = ()) -> DataFrame:
    """Pairs of boxes (with columns prefixed by f and c) that touch or overlap, the first not coarser than the second.

    A coarse box touches a fine one if it holds one of the fine one's neighbours or the fine
    one itself: these are the cells that the fine box's neighbours are in, at every level up.
    A larger box that holds the fine one is in no pair but at the levels own. So a cell is looked
    up by the boxes along its rim, not by all that it holds, and the root by itself alone.
    """
    return rim_cells(fine, f, c, d, own).join(coarse, side(c, d))


@dataclass
class Traversal:
    """Lists of a tree for well-separatedness n (boxes n away), and for trees with extents a criterion
    for smaller boxes and the number of sources below which they go to the close list."""

    tree: Tree
    n: int = 1
    criterion: str | None = None
    min_sources: int = 0
    #: Boxes (level, keys) that may be sources; all if there is none.
    source_mask: DataFrame | None = None
    #: Boxes (level, keys) that may be parents of sources: list 3 goes down through these alone. All if there is none.
    source_parent_mask: DataFrame | None = None
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        if self.n < 1:
            raise ValueError("n must be 1 or more")
        if self.tree.has_extent:
            self.criterion = self.criterion or "precise_linf"
            if self.criterion not in CRITERIA:
                raise ValueError(f"the criterion must be one of {CRITERIA}")
            if self.tree.norm == "l2" and self.criterion == "static_linf":
                raise ValueError("static_linf does not go with the l2 norm")
        d = self.tree.d
        # A tree of boxes alone has no points: each of its boxes is a source and a target.
        holds = lambda c: F.col(c) > 0 if self.tree.particles is not None else F.lit(True)
        boxes = self.tree.boxes.withColumns({"is_source": holds("n_src_own"), "is_target": holds("n_tgt_own"), "is_source_parent": F.col("is_split")})
        for given, flag in ((self.source_mask, "is_source"), (self.source_parent_mask, "is_source_parent")):
            if given is not None:
                mask = given.select(*box_names(d)).distinct().withColumn("_in", F.lit(True))
                boxes = boxes.join(mask, box_names(d), "left").withColumn(flag, F.col(flag) & F.coalesce("_in", F.lit(False))).drop("_in")
        self.boxes = cut(boxes)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def source_boxes(self) -> DataFrame:
        return self.boxes.where("is_source").select(*box_names(self.tree.d))

    @property
    def source_parent_boxes(self) -> DataFrame:
        return self.boxes.where("is_source_parent").select(*box_names(self.tree.d))

    @property
    def target_boxes(self) -> DataFrame:
        return self.boxes.where("is_target").select(*box_names(self.tree.d))

    @property
    def target_or_target_parent_boxes(self) -> DataFrame:
        return self.boxes.where("is_target OR is_split").select(*box_names(self.tree.d))

    def class_levels(self) -> DataFrame:
        """For each class of boxes and level that has some: n_boxes, and first, how many there are on the levels above."""
        flags = {"source": "is_source", "source_parent": "is_source_parent", "target": "is_target", "target_or_parent": "is_target OR is_split"}
        kinds = F.array_compact(F.array(*[F.when(F.expr(flag), F.lit(name)) for name, flag in flags.items()]))
        counts = self.boxes.select("level", F.explode(kinds).alias("box_class")).groupBy("box_class", "level").agg(F.count(F.lit(1)).alias("n_boxes"))
        above = W.partitionBy("box_class").orderBy("level").rowsBetween(W.unboundedPreceding, -1)  # of a few levels
        return counts.withColumn("first", F.coalesce(F.sum("n_boxes").over(above), F.lit(0)))

    def _edges(self, df: DataFrame) -> DataFrame:
        return df.select(*side("t", self.tree.d), *side("s", self.tree.d))

    @property
    def colleagues(self) -> DataFrame:
        """Other boxes of the same level, at most n away on every axis."""
        return self._once("colleagues", lambda: cut(self._edges(self._colleagues_of(self.boxes))))

    def _colleagues_of(self, boxes: DataFrame) -> DataFrame:
        d, names = self.tree.d, key_names(self.tree.d)
        t = boxes.where("level > 0").select(*box_names(d), F.explode(moved(names, self.n)).alias("_c"))
        probes = t.select(*[F.col(c).alias(f"t_{c}") for c in box_names(d)], F.col("level").alias("s_level"), *[F.col(f"_c.{k}").alias(f"s_{k}") for k in names])
        return probes.join(prefixed(self.boxes, "s", d), side("s", d))

    @property
    def list1(self) -> DataFrame:
        """Source boxes of any level that touch a target box, itself included."""

        def make():
            d = self.tree.d
            t, s = prefixed(self.target_boxes, "t", d), prefixed(self.source_boxes, "s", d)
            # Boxes with points of their own that hold other boxes: they take extents, or boxes alone. TOP + 1 levels at most.
            holding = self.boxes.where("is_split AND (is_source OR is_target)").select("level").distinct()
            own = tuple(r["level"] for r in holding.collect()) if self.tree.has_extent or self.tree.particles is None else ()
            up = touching(t, "t", s, "s", d, own)
            down = touching(s, "s", t, "t", d, own).where("s_level > t_level")
            return self._edges(up).unionByName(self._edges(down))

        return self._once("list1", make)

    @property
    def list2(self) -> DataFrame:
        """Children of the parent's colleagues that are more than n away."""

        def make():
            d, n, names = self.tree.d, self.n, key_names(self.tree.d)
            t = prefixed(self.target_or_target_parent_boxes, "t", d).where("t_level > 0")
            # Children of the parent and of its colleagues, less those that are near.
            up = [shift(F.col(f"t_{k}"), 1) for k in names]
            around = block([f"s_{k}" for k in names], [2 * (u - n) for u in up], [2 * (u + n) + 1 for u in up])
            far = F.filter(around, lambda c: F.greatest(*[F.abs(c[f"s_{k}"] - F.col(f"t_{k}")) for k in names], F.lit(0)) > n)
            probes = t.select("*", F.col("t_level").alias("s_level"), F.explode(far).alias("_c")).select(*t.columns, "s_level", "_c.*")
            return self._edges(probes.join(prefixed(self.boxes, "s", d), side("s", d)))

        return self._once("list2", make)

    def _center_apart(self, p: str, q: str) -> list[Column]:
        """Distances of the centres of boxes p and q on each axis."""
        tree = self.tree
        center = lambda x, i, k: tree.center(i, F.col(f"{x}_level"), F.col(f"{x}_{k}"))
        return [F.abs(center(p, i, k) - center(q, i, k)) for i, k in enumerate(key_names(tree.d))]

    def _separated(self) -> Column:
        """Whether a smaller source box is far enough from a target box, by the criterion."""
        tree, d = self.tree, self.tree.d
        if not tree.has_extent:
            return F.lit(True)
        r_s, reach = tree.radius(F.col("s_level")), (1 + tree.stick_out) * tree.radius(F.col("t_level"))
        least = (2 - SLACK) * r_s
        if self.criterion == "static_l2":
            return F.sqrt(sum((c * c for c in self._center_apart("t", "s")), F.lit(0.0))) - d**0.5 * reach - r_s >= least
        if self.criterion == "static_linf":
            gaps = [c - reach - r_s for c in self._center_apart("t", "s")]
        else:
            middle = lambda a: (F.col(f"t_min_{a}") + F.col(f"t_max_{a}")) / 2
            half = lambda a: (F.col(f"t_max_{a}") - F.col(f"t_min_{a}")) / 2
            gaps = [F.abs(middle(a) - tree.center(i, F.col("s_level"), F.col(f"s_i{a}"))) - half(a) - r_s for i, a in enumerate(axes(d))]
        return F.greatest(F.lit(0.0), *gaps) >= least

    def _smaller(self) -> tuple[DataFrame, DataFrame]:
        """Lists 3 and 3 close, by going down from the colleagues of target boxes, a level a step.

        A box that is separated is in the list and ends the way; one that is not goes on to
        its children. Steps end when no box is left.
        """
        d, names = self.tree.d, key_names(self.tree.d)
        start = self._edges(self._colleagues_of(self.boxes.where("is_target"))).join(prefixed(self.source_parent_boxes, "s", d), side("s", d), "left_semi")
        extra = []
        if self.tree.has_extent and self.criterion == "precise_linf":
            bounds = prefixed(box_extents(self.tree, ("t", "b")), "t", d, *[f"{m}_{a}" for a in axes(d) for m in ("min", "max")])
            start = start.join(bounds, side("t", d))
            extra = bounds.columns[1 + d :]
        counted = ("n_src_cumul",) if self.tree.has_extent else ()
        source = prefixed(self.boxes.where("is_source OR is_source_parent"), "s", d, "is_source", "is_source_parent", *counted)
        enough = F.col("s_n_src_cumul") >= self.min_sources if self.tree.has_extent else F.lit(True)
        far, close, now = [], [], cut(start)
        while now.take(1):
            kids = F.array(*[F.struct(*[(F.col(f"s_{k}") * 2 + o).alias(f"s_{k}") for k, o in zip(names, move)]) for move in offsets(d, 1, zero=True) if min(move) >= 0])
            below = now.select(*side("t", d), *extra, (F.col("s_level") + 1).alias("s_level"), F.explode(kids).alias("_c")).select(*side("t", d), *extra, "s_level", "_c.*")
            found = cut(below.join(source, side("s", d)).withColumn("_touch", near("t", d, 1)).withColumn("_ok", ~F.col("_touch") & self._separated() & enough))
            far.append(self._edges(found.where("_ok")))
            close.append(self._edges(found.where("NOT _ok AND NOT _touch AND s_is_source")))
            now = found.where("NOT _ok AND s_is_source_parent").select(*side("t", d), *extra, *side("s", d))
        none = self._edges(now)
        for f in far:
            none = none.unionByName(f)
        shut = self._edges(now)
        for f in close:
            shut = shut.unionByName(f)
        return none, shut

    @property
    def list3(self) -> DataFrame:
        """Smaller source boxes, below colleagues of a target box, that are separated from it while their parents are not."""
        self._once("smaller", self._smaller)
        return self._made["smaller"][0]

    @property
    def list3_close(self) -> DataFrame:
        """Smaller source boxes that don't touch but aren't separated either; only with extents."""
        self._once("smaller", self._smaller)
        return self._made["smaller"][1]

    def _bigger(self) -> DataFrame:
        """Edges of lists 4 and 4 close: _close tells which, from keys alone, before the sources are looked up."""
        tree, d, n, names = self.tree, self.tree.d, self.n, key_names(self.tree.d)
        t = prefixed(self.boxes.where("(is_target OR is_split) AND level > 0"), "t", d, "is_target")
        last = F.col("t_level") - (1 if n == 1 else 0)
        at = t.select("*", F.explode(levels(1, last)).alias("s_level"))
        up = F.col("t_level") - F.col("s_level")
        cells = F.array(*[F.struct(*[(shift(F.col(f"t_{k}"), up) + o).alias(f"s_{k}") for k, o in zip(names, move)]) for move in offsets(d, n)])
        probes = at.select("*", F.explode(cells).alias("_c")).select(*t.columns, "s_level", "_c.*", (F.col("t_level") - 1).alias("p_level"), *[shift(F.col(f"t_{k}"), 1).alias(f"p_{k}") for k in names])
        apart = probes.where(inside_of("s", d)).where(~near("t", d, 1))
        upper = ~near("p", d, 1) & (F.lit(n == 1) | (F.col("s_level") < F.col("t_level")))
        if not tree.has_extent:
            kept = apart.where(~upper).withColumn("_close", F.lit(False))
        else:
            far = lambda p: F.greatest(*self._center_apart(p, "s"), F.lit(0.0)) >= (3 * (1 + tree.stick_out) * tree.radius(F.col(f"{p}_level")) + tree.radius(F.col("s_level"))) * (1 - SLACK)
            kept = apart.withColumn("_close", ~far("t")).where((F.col("_close") & F.col("t_is_target")) | (~F.col("_close") & (~upper | ~far("p"))))
        return cut(kept.join(prefixed(self.source_boxes, "s", d), side("s", d)).select(*side("t", d), *side("s", d), "_close"))

    @property
    def list4(self) -> DataFrame:
        """Bigger source boxes that are separated from a box while they are not from its parent."""
        return self._edges(self._once("bigger", self._bigger).where("NOT _close"))

    @property
    def list4_close(self) -> DataFrame:
        """Bigger source boxes that neither touch a target box nor are separated from it; only with extents."""
        return self._edges(self._once("bigger", self._bigger).where("_close"))

    @property
    def list1_merged(self) -> DataFrame:
        """List 1 with the close lists."""
        return self.list1.unionByName(self.list3_close).unionByName(self.list4_close)

    def box_list(self, name: str, level: int, *keys: int) -> DataFrame:
        """One box's part of a list."""
        edges = getattr(self, name).where(F.col("t_level") == level)
        for k, value in zip(key_names(self.tree.d), keys):
            edges = edges.where(F.col(f"t_{k}") == value)
        return edges.select(*[F.col(c).alias(c[2:]) for c in side("s", self.tree.d)])


def inside_of(prefix: str, d: int) -> Column:
    names = [f"{prefix}_{k}" for k in key_names(d)]
    return inside(names, F.col(f"{prefix}_level"))


def csr(edges: DataFrame, d: int) -> DataFrame:
    """An edge table with a row for each target box: its source boxes as a sorted array."""
    return edges.groupBy(*side("t", d)).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(c[2:]) for c in side("s", d)]))).alias("sources"))
