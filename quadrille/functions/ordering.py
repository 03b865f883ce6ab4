"""Numbering the rows of a table in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.plans.shared import cut

#: Bits of monotonically_increasing_id that hold a row's place in its partition.
BITS = 33


def _dealt(df: DataFrame, order: list) -> DataFrame:
    """df dealt by ranges of the order and sorted, in one shuffle: _range, and _in, a row's place there."""
    kept = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return kept.withColumn("_range", F.shiftright("_at", BITS)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << BITS) - 1))).drop("_at")


def _with_before(dealt: DataFrame, ends: DataFrame, f) -> DataFrame:
    """dealt with _before, what f makes of the column _v of the ranges before a row's own.

    ends has one row a range, so at most as many as the shuffle has partitions, and is broadcast.
    """
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return dealt.join(F.broadcast(ends.select("_range", f("_v").over(before).alias("_before"))), "_range")


def numbered(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """df with its place in the order of the columns order, from first on."""
    dealt = _dealt(df, order)
    rows = _with_before(dealt, dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_v")), F.sum)
    place = F.coalesce("_before", F.lit(0)) + F.col("_in") + first
    return rows.withColumn(name, place.cast("long")).drop("_range", "_in", "_before")


def running(df: DataFrame, order: list, value: str, name: str, how: str = "sum") -> DataFrame:
    """df with the running sum or minimum of value up to each row in the order of the columns order.

    A window runs inside each range of the order, and what the ranges before it give is added from one
    number a range.
    """
    f = {"sum": F.sum, "min": F.min}[how]
    dealt = _dealt(df, order)
    rows = _with_before(dealt, dealt.groupBy("_range").agg(f(value).alias("_v")), f)
    here = f(value).over(W.partitionBy("_range").orderBy("_in").rowsBetween(W.unboundedPreceding, 0))
    both = here + F.coalesce("_before", F.lit(0)) if how == "sum" else F.least(here, "_before")
    return rows.withColumn(name, both).drop("_range", "_in", "_before")


def running_within(df: DataFrame, by: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """df with running sums of some values within the rows of equal by (not null), in the order of the columns order.

    The table is sorted by range, so the rows of one by may lie in many ranges: a window runs inside each range,
    and what earlier ranges hold of the by that a range begins with is added. These are one row a range: of all
    that an earlier range holds, only the by that it ends with can go on in a later one.
    """
    names = list(sums)
    dealt = _dealt(df.withColumns(sums), [by, *order])
    here = W.partitionBy("_range", by).orderBy("_in").rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.withColumns({n: F.sum(n).over(here) for n in names})
    held = dealt.groupBy("_range", by).agg(*[F.sum(n).alias(n) for n in names])
    ends = held.groupBy("_range").agg(F.min(by).alias("_first"), F.max(F.struct(by, *names)).alias("_last"))
    begun = ends.select("_range", F.col("_first").alias(by))
    over = ends.select(F.col("_range").alias("_earlier"), "_last.*").join(begun, by).where("_earlier < _range")
    carried = over.groupBy("_range", by).agg(*[F.sum(n).alias(f"_carried_{n}") for n in names])
    both = rows.join(F.broadcast(carried), ["_range", by], "left")  # at most as many rows as there are ranges
    return both.withColumns({n: F.col(n) + F.coalesce(f"_carried_{n}", F.lit(0)) for n in names}).drop("_range", "_in", *[f"_carried_{n}" for n in names])
