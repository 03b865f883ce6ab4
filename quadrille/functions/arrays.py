"""What array code does with indices, as tables of (index, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions.ordering import numbered, running


def reverse_index(permutation: DataFrame, index: str, value: str) -> DataFrame:
    """The inverse of a permutation: index and value change places."""
    return permutation.select(F.col(value).alias(index), F.col(index).alias(value))


def gather(values: DataFrame, at: DataFrame, index: str = "i") -> DataFrame:
    """For each row of at (a number and an index to read) the values' row of that index; rows without one are left out."""
    return at.join(values, index)


def compacted(rows: DataFrame, keep: Column, order: list, name: str) -> DataFrame:
    """The rows that keep holds for, numbered anew in the order of the columns order."""
    return numbered(rows.where(keep), order, name)


def mask_lists(masks: DataFrame, row: str, mask: str) -> DataFrame:
    """Of arrays of flags the places (from 0) that are set, a row for each."""
    return masks.select(row, F.posexplode(mask).alias("place", "_set")).where("_set").select(row, "place")


def search_sorted(values: DataFrame, value: str, starts: DataFrame, start: str, name: str) -> DataFrame:
    """values with the largest number of a row of starts, counted from 0 in ascending order, whose start is
    not above the value; -1 if there is none.

    Both tables are sorted together, starts before equal values, and starts are counted along the way:
    no range join and no pairs.
    """
    both = values.select(F.col(value).alias("_v"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_one"), F.struct(*values.columns).alias("_row"))
    both = both.unionByName(starts.select(F.col(start).alias("_v"), F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("_one")), allowMissingColumns=True)
    counted = running(both, ["_v", "_kind"], "_one", "_n")
    return counted.where("_kind = 1").select("_row.*", (F.col("_n") - 1).alias(name))
