"""Point sets: readers that map tables to points, and generators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points of the plane, by price and customer; with a role, a radius and a weight to use or drop."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pid"),
        (F.col("o_totalprice") / F.lit(500000.0)).alias("x"),
        (F.col("o_custkey") / F.lit(1500.0)).alias("y"),
        F.when(F.col("o_orderkey") % 3 == 0, "t").otherwise("s").alias("role"),
        F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 17) / F.lit(400.0)).otherwise(0.0).alias("radius"),
        (F.col("o_orderkey") % 9 + 1).cast("long").alias("weight"),
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by value and number, a skewed set."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), (F.col("value") / F.lit(500.0)).alias("x"), (F.col("event_id") / F.lit(10000.0)).alias("y"))


def event_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a role, and a small radius for the targets."""
    target = F.col("pid") % 3 == 0
    return event_points(spark, sf_dir).select("*", F.when(target, "t").otherwise("s").alias("role"), F.when(target, (F.col("pid") % 17) / F.lit(6000.0)).otherwise(0.0).alias("radius"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of the embeddings, points of space."""
    name = next(f.name for f in table(spark, sf_dir, "embeddings").schema if f.dataType.typeName() == "array")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *[F.col(name)[i].cast("double").alias(a) for i, a in enumerate("xyz")])


def customer_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as balls, some of them outside of the orders' range."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ball_id"), (F.col("c_acctbal") / F.lit(11000.0)).alias("x"), (F.col("c_custkey") / F.lit(1500.0)).alias("y"), ((F.col("c_custkey") % 13 + 1) / F.lit(200.0)).alias("radius"))


def line_point_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as point sources that hang on orders."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"))


def normal_points(spark: SparkSession, n: int, d: int, seed: int = 15) -> DataFrame:
    """n points, each coordinate from a standard normal distribution."""
    return spark.range(n).select(F.col("id").alias("pid"), *[F.randn(seed + i).alias(a) for i, a in enumerate("xyz"[:d])])


def surface_points(spark: SparkSession, n: int, d: int) -> DataFrame:
    """Points of a closed curve in the plane, or of a torus (about n, a square number) in space."""
    if d == 2:
        phi = F.col("id") * F.lit(2 * math.pi / n)
        return spark.range(n).select(F.col("id").alias("pid"), (0.5 * (3 * F.cos(phi) + 2 * F.sin(3 * phi))).alias("x"), (0.5 * (F.sin(phi) + 1.5 * F.sin(2 * phi))).alias("y"))
    if d != 3:
        raise ValueError("surfaces have 2 or 3 dimensions")
    side = math.isqrt(n)
    phi, theta = F.floor(F.col("id") / side) * F.lit(2 * math.pi / side), (F.col("id") % side) * F.lit(2 * math.pi / side)
    return spark.range(side * side).select(F.col("id").alias("pid"), (5 * F.cos(phi) * (3 + F.cos(theta))).alias("x"), (5 * F.sin(phi) * (3 + F.cos(theta))).alias("y"), (5 * F.sin(theta)).alias("z"))


def uniform_points(spark: SparkSession, n: int, d: int) -> DataFrame:
    """A turned grid of about n points with sides of 4 around the origin."""
    if d not in (2, 3):
        raise ValueError("grids have 2 or 3 dimensions")
    side = max(2, round(n ** (1 / d)))
    at = [(F.floor(F.col("id") / side**i) % side) * F.lit(4.0 / (side - 1)) for i in range(d)]
    turn = lambda a, b, angle: (math.cos(angle) * a - math.sin(angle) * b, math.sin(angle) * a + math.cos(angle) * b)
    at[0], at[1] = turn(at[0], at[1], 0.3)
    if d == 3:
        at[1], at[2] = turn(at[1], at[2], 0.7)
    return spark.range(side**d).select(F.col("id").alias("pid"), *[(c - 2.0).alias(a) for a, c in zip("xyz", at)])
