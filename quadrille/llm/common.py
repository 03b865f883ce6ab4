"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the text operators, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and runs on one machine, as in tests, a temporary
    folder is made and set as the checkpoint folder; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path, read again."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffles and checkpoints that nothing refers to any more: it does so after a garbage
    collection of the driver, which may else come late. It bears on disk alone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def looked_up(rows: DataFrame, values: DataFrame, key: str, by: str, runs: int = 64, how: str = "inner") -> DataFrame:
    """rows joined with values, which has one row a key; with how as left, rows without a value stay.

    Rows of a key that many share are dealt to runs by the column by, and each run gets
    the key's values once, so that such rows meet their value in many tasks.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(runs)))
    copies = dealt.select(key, "_part").distinct().join(values, key)
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def beside(df: DataFrame, **more: Column) -> DataFrame:
    """The whole row of df as the struct _row, beside columns of one's own: names in df cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(name) for name, c in more.items()])


def row_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of df again, out of _row."""
    return [F.col("_row").getField(c).alias(c) for c in df.columns if c not in without]
