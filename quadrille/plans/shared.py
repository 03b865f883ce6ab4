"""Where intermediate tables are kept."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, without its lineage.

    The folder is the session's spark.checkpoint.dir. Only where it names none and the
    session runs on one machine, as in tests, a temporary one is set; elsewhere that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete shuffles and checkpoints that nothing refers to any more; it bears on disk alone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rounded(c: Column, digits: int) -> Column:
    """c rounded as the SQL's round does, by a multiplication; Spark's goes by the shortest decimals of c, which differs near halves."""
    return F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)
