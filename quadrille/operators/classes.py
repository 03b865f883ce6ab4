"""Translation and rotation classes of list 2."""

from __future__ import annotations

from math import gcd, sqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.functions.keys import TOP, axes, key_names
from quadrille.operators.traversal import Traversal


def class_count(n: int, d: int) -> int:
    """How many classes there are on a level."""
    return (4 * n + 3) ** d


def class_number(vector: list, n: int):
    """The number of a vector of cells, each from -(2n+1) to 2n+1, in the base 4n + 3; for columns, arrays and numbers."""
    base = 4 * n + 3
    return sum((2 * n + 1 + v) * base**k for k, v in enumerate(vector))


def class_vector(number, n: int, d: int) -> list:
    """The vector of a class number, whatever its level; the inverse of class_number."""
    base, div = 4 * n + 3, lambda x, by: F.floor(x / F.lit(by)) if isinstance(x, Column) else x // by
    return [div(number, base**k) % base - (2 * n + 1) for k in range(d)]


def _checked(number: Column, ok: Column, message: str) -> Column:
    return F.when(ok, number).otherwise(F.raise_error(F.lit(message)).cast("long"))


def translation_classes(traversal: Traversal, per_level: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """list 2, or other edges of boxes of one level, with the vector from source to target in cells (v_x, ...) and its
    class, per level if wanted. A vector that is not one of list 2 is an error."""
    d, n = traversal.tree.d, traversal.n
    if class_count(n, d) * (TOP + 1) > 2**63 - 1:
        raise ValueError("the numbers of translation classes would not fit into 64 bits")
    vector = [F.col(f"t_{k}") - F.col(f"s_{k}") for k in key_names(d)]
    number = class_number(vector, n) + (F.col("t_level") * F.lit(class_count(n, d)) if per_level else 0)
    ok = F.col("t_level") == F.col("s_level")
    for v in vector:
        ok &= F.abs(v) <= 2 * n + 1
    number = _checked(number.cast("long"), ok, "boxes are too far apart for a translation class")
    return (traversal.list2 if edges is None else edges).select("*", *[v.alias(f"v_{a}") for a, v in zip(axes(d), vector)], number.alias("class_number"))


def used_classes(traversal: Traversal) -> DataFrame:
    """The classes that occur, numbered from 0 in ascending order, with their distance vectors, from the number back.

    There are not more than a few hundred a level, so a single window over them is small.
    """
    d, n, tree = traversal.tree.d, traversal.n, traversal.tree
    used = translation_classes(traversal).select("class_number", F.col("t_level").alias("level")).distinct()
    vector = class_vector(F.col("class_number") - F.col("level") * F.lit(class_count(n, d)), n, d)
    used = used.select("*", *[v.cast("long").alias(f"v_{a}") for a, v in zip(axes(d), vector)])
    place = F.row_number().over(W.orderBy("class_number")) - 1
    width = F.lit(tree.width) / F.pow(F.lit(2.0), F.col("level"))
    return used.select("class_number", "level", place.cast("long").alias("class_id"), *[f"v_{a}" for a in axes(d)], *[(F.col(f"v_{a}") * width).alias(f"distance_{a}") for a in axes(d)])


def class_level_starts(traversal: Traversal) -> DataFrame:
    """The first class_id of each level that has classes, and how many it has."""
    return used_classes(traversal).groupBy("level").agg(F.min("class_id").alias("first_class"), F.count(F.lit(1)).alias("n_classes"))


def rotation_classes(traversal: Traversal) -> DataFrame:
    """The rotation class and angle to the last axis of each used translation class.

    An angle is told by the sign of the vector's last part and the square of that part over
    the square of the length, as a reduced fraction; classes are numbered by the first
    translation class that has their angle. These of the (4n + 3)^d possible vectors are a
    small table.
    """
    d, n = traversal.tree.d, traversal.n
    spark = traversal.tree.boxes.sparkSession
    rows = []
    for v in (class_vector(number, n, d) for number in range(class_count(n, d))):
        norm2 = sum(x * x for x in v)
        if norm2:
            g = gcd(v[-1] ** 2, norm2)
            rows.append((*v, norm2 // g, (v[-1] > 0) - (v[-1] < 0), v[-1] ** 2 // g, v[-1] / sqrt(norm2)))
    schema = ", ".join([*[f"v_{a} bigint" for a in axes(d)], "_norm2 bigint", "_sign int", "_last2 bigint", "_cos double"])
    vectors = spark.createDataFrame(rows, schema)
    used = used_classes(traversal).join(F.broadcast(vectors), [f"v_{a}" for a in axes(d)])  # (4n + 3)^d rows
    first = F.min("class_id").over(W.partitionBy("_sign", "_last2", "_norm2"))
    number = (F.dense_rank().over(W.orderBy("_first")) - 1).cast("long")
    number = _checked(number, number < most_rotation_classes(n, d), "there are more rotation classes than there can be")
    return used.withColumn("_first", first).select("class_number", "class_id", number.alias("rotation_class"), F.acos("_cos").alias("angle"))


def most_rotation_classes(n: int, d: int) -> int:
    """A bound of the number of rotation classes."""
    return 2 ** (d - 1) * (2 * n + 1) ** d
