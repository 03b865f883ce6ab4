"""Cost model of a hierarchical sum: per box, per stage, and its calibration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions.keys import TOP, box_names
from quadrille.operators.traversal import Traversal, prefixed, side

PARAMETERS = ("c_p2p", "c_p2l", "c_l2p", "c_p2m", "c_m2p", "c_m2m", "c_l2l", "c_m2l")
STAGES = ("form_multipoles", "coarsen_multipoles", "eval_direct", "multipole_to_local", "eval_multipoles", "form_locals", "refine_locals", "eval_locals")


@dataclass(frozen=True)
class TranslationCost:
    """Costs from the number of coefficients of a level. With point and shoot, moving an expansion
    turns it to an axis, moves it along it and turns it back."""

    coefficients: Callable[[int], float]
    point_and_shoot: bool = False

    def between(self, source_level: int, target_level: int) -> float:
        s, t = self.coefficients(source_level), self.coefficients(target_level)
        return s**1.5 + s**0.5 * t + t**1.5 if self.point_and_shoot else s * t


def pde_aware(d: int, order: Callable[[int], int]) -> TranslationCost:
    return TranslationCost(lambda level: (order(level) + 1) ** (d - 1), d == 3)


def taylor(d: int, order: Callable[[int], int]) -> TranslationCost:
    return TranslationCost(lambda level: (order(level) + 1) ** d)


def unit_parameters() -> dict[str, float]:
    return dict.fromkeys(PARAMETERS, 1.0)


class CostModel:
    def __init__(self, traversal: Traversal, cost: TranslationCost, parameters: dict[str, float] | None = None):
        self.traversal, self.d, self.c = traversal, traversal.tree.d, parameters or unit_parameters()
        spark = traversal.tree.boxes.sparkSession
        # A row for each level there can be, so it can always be broadcast.
        rows = [(n, *(float(self.c[k] * cost.coefficients(n)) for k in ("c_p2m", "c_l2p", "c_m2p", "c_p2l")), float(self.c["c_m2l"] * cost.between(n, n)), float(self.c["c_m2m"] * cost.between(n + 1, n)), float(self.c["c_l2l"] * cost.between(n, n + 1))) for n in range(TOP + 2)]
        self.factors = spark.createDataFrame(rows, "level int, p2m double, l2p double, m2p double, p2l double, m2l double, m2m double, l2l double")

    def _factor(self, df: DataFrame, name: str, level: str = "level") -> DataFrame:
        return df.join(F.broadcast(self.factors.select(F.col("level").alias(level), F.col(name).alias("_factor"))), level)

    def _boxes(self) -> DataFrame:
        return self.traversal.boxes

    def form_multipoles(self) -> DataFrame:
        rows = self._factor(self._boxes().where("is_source"), "p2m")
        return rows.select(*box_names(self.d), (F.col("n_src_own") * F.col("_factor")).alias("cost"))

    def direct_sources(self) -> DataFrame:
        """For each target box the sources that act on it directly."""
        own = prefixed(self._boxes(), "s", self.d, "n_src_own")
        t = self.traversal
        near = t.list1_merged if t.tree.has_extent else t.list1
        sums = near.join(own, side("s", self.d)).groupBy(*side("t", self.d)).agg(F.sum("s_n_src_own").alias("n_direct"))
        return sums.select(*[F.col(f"t_{c}").alias(c) for c in box_names(self.d)], "n_direct")

    def eval_direct(self) -> DataFrame:
        rows = self._boxes().where("is_target").join(self.direct_sources(), box_names(self.d))
        return rows.select(*box_names(self.d), (F.col("n_tgt_own") * F.col("n_direct") * F.lit(float(self.c["c_p2p"]))).alias("cost"))

    def _by_target(self, edges: DataFrame, amount: Column) -> DataFrame:
        sums = edges.groupBy(*side("t", self.d)).agg(F.sum(amount).alias("cost"))
        return sums.select(*[F.col(f"t_{c}").alias(c) for c in box_names(self.d)], "cost")

    def multipole_to_local(self) -> DataFrame:
        return self._by_target(self._factor(self.traversal.list2, "m2l", "t_level"), F.col("_factor"))

    def eval_multipoles(self) -> DataFrame:
        targets = prefixed(self._boxes(), "t", self.d, "n_tgt_own")
        edges = self._factor(self.traversal.list3.join(targets, side("t", self.d)), "m2p", "s_level")
        return self._by_target(edges, F.col("t_n_tgt_own") * F.col("_factor"))

    def form_locals(self) -> DataFrame:
        """By the level of the source box."""
        sources = prefixed(self._boxes(), "s", self.d, "n_src_own")
        edges = self._factor(self.traversal.list4.join(sources, side("s", self.d)), "p2l", "s_level")
        return self._by_target(edges, F.col("s_n_src_own") * F.col("_factor"))

    def eval_locals(self) -> DataFrame:
        rows = self._factor(self._boxes().where("is_target"), "l2p")
        return rows.select(*box_names(self.d), (F.col("n_tgt_own") * F.col("_factor")).alias("cost"))

    def _total(self, rows: DataFrame, amount: Column) -> DataFrame:
        return rows.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("cost"))

    def coarsen_multipoles(self) -> DataFrame:
        """One move for each box of level 3 and deeper, into its parent."""
        rows = self._boxes().where("level >= 3").withColumn("level", F.col("level") - 1)
        return self._total(self._factor(rows, "m2m"), F.col("_factor"))

    def refine_locals(self) -> DataFrame:
        """One move for each target or target parent box but the root, from its parent."""
        rows = self._boxes().where("level >= 1 AND (is_target OR is_split)").withColumn("level", F.col("level") - 1)
        return self._total(self._factor(rows, "l2l"), F.col("_factor"))

    def per_box(self) -> DataFrame:
        """The cost of each box in all stages that belong to boxes; 0 for boxes without."""
        parts = self._boxes().select(*box_names(self.d), F.lit(0.0).alias("cost"))
        for stage in STAGES:
            if stage not in ("coarsen_multipoles", "refine_locals"):
                parts = parts.unionByName(getattr(self, stage)())
        return parts.groupBy(*box_names(self.d)).agg(F.sum("cost").alias("cost"))

    def per_stage(self) -> DataFrame:
        out = None
        for stage in STAGES:
            rows = self._total(getattr(self, stage)(), F.col("cost")).select(F.lit(stage).alias("stage"), "cost")
            out = rows if out is None else out.unionByName(rows)
        return out


def calibration(timings: DataFrame) -> DataFrame:
    """For each stage of timings (stage, modeled, elapsed) the slope through the origin of elapsed on modeled; 0 if nothing was modeled."""
    a, u = F.sum(F.col("elapsed") * F.col("modeled")), F.sum(F.col("modeled") * F.col("modeled"))
    return timings.groupBy("stage").agg(F.when(u > 1e-15, a / u).otherwise(0.0).alias("parameter"))
