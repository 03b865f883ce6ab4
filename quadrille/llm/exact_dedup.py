"""Exact dedup: a tree merge of sorted digest runs.

Each document is reduced to a signature. Documents are dealt to ``runs`` runs by
a hash of their id; a run is sorted by signature and holds each one once, with the smallest
doc_id and a count. Rounds are binomial: in each, a run and its partner, whose number differs in
one bit, exchange what they have by signature, so that a task merges the sorted blocks that it
gets from all tasks of the round before, keeps the smallest id of each signature and leaves a
sorted run again, until one run is left (with another ``fan_in`` as many runs meet). A signature
has at most ``fan_in`` rows in any merge, however many copies it has. Each round's runs are kept
by a checkpoint, from which a lost task begins again. The decisions go from the last run to the
first ones, where a signature has ``runs`` rows at most, and from there to the documents of each
run: a text with a third of all copies is never gathered in one task.

A signature is the SHA-256 of the normalised text, verified at each level by the
text's length and a second, unrelated hash, which are part of what is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quadrille.llm.common import SPACE, beside, cut, row_columns, table, text_or_empty

#: What must be equal for two texts to count as equal.
KEY = ["_digest", "_length", "_check"]


def normalised(column: str = "text") -> Column:
    """The text with each stretch of white space as one space; null as empty."""
    return F.regexp_replace(text_or_empty(column), SPACE, " ")


def signed_columns() -> list[Column]:
    """The signature of a normalised text _norm."""
    # Told not to be null, so that joins don't compute it a second time to find out.
    digest = F.coalesce(F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)), F.lit(b""))
    return [digest.alias("_digest"), F.octet_length("_norm").alias("_length"), F.xxhash64("_norm").alias("_check")]


def signature(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row (_id, _digest, _length, _check) for each row of df."""
    return df.select(F.col(id_column).alias("_id"), normalised(text_column).alias("_norm")).select("_id", *signed_columns())


def _merge(level: DataFrame, fan_in: int) -> DataFrame:
    """One round: runs that share _run div fan_in meet, sorted by signature and id, and leave one sorted run."""
    key = W.partitionBy("_up", *KEY)
    return (
        level.withColumn("_up", F.expr(f"_run div {fan_in}"))
        .withColumn("_at", F.row_number().over(key.orderBy(F.col("_keep").asc_nulls_last())))
        .withColumn("_size", F.sum("_size").over(key))
        .where("_at = 1")
        .select(F.col("_up").alias("_run"), *KEY, "_keep", "_size")
    )


def rounds(signatures: DataFrame, runs: int, fan_in: int) -> list[DataFrame]:
    """The runs of every level of the tree, from the first ones to the last: _run, the signature, _keep and _size.

    The partitions of each are sorted by run and signature.
    """
    first = signatures.groupBy("_run", *KEY).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    levels = [cut(first.sortWithinPartitions("_run", *KEY))]
    while runs > 1:
        levels.append(cut(_merge(levels[-1], fan_in)))
        runs = -(-runs // fan_in)
    return levels


def decisions(signatures: DataFrame, runs: int = 64, fan_in: int = 2) -> DataFrame:
    """For each signature row: _id, the signature, keep_id, group_size and kept.

    signatures must give the same rows whenever it is read (a table or a checkpoint).
    Rows of null id keep their row; a null id counts as larger than any other.
    Of rows that repeat both the id and the text one is kept.
    """
    if fan_in < 2 or runs < 1:
        raise ValueError("runs must be 1 or more and fan_in 2 or more")
    dealt = signatures.withColumn("_run", F.pmod(F.xxhash64("_id", "_digest"), F.lit(runs)))
    levels = rounds(dealt, runs, fan_in)
    decided = levels[0].select(F.col("_run").alias("_up"), *KEY).join(levels[-1].drop("_run"), KEY)
    rows = dealt.withColumnRenamed("_run", "_up").join(decided, ["_up", *KEY])
    first = F.row_number().over(W.partitionBy("_up", *KEY, "_id").orderBy("_check"))
    return rows.select("_id", *KEY, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_id").eqNullSafe(F.col("_keep")) & (first == 1)).alias("kept"))


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: int = 64, fan_in: int = 2) -> DataFrame:
    """The decision on every row of df: its id, keep_id, group_size, kept and text_sha256.

    Null and empty texts are equal to each other, and differ from a text of white
    space only, which normalises to one space. An empty table gives an empty result.
    """
    found = decisions(cut(signature(df, id_column, text_column)), runs, fan_in)
    return found.select(F.col("_id").alias(id_column), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: int = 64, fan_in: int = 2) -> DataFrame:
    """The rows of df that stay, with all columns of df.

    Of rows that repeat id and text (other columns may differ) one stays, the
    first by the other columns' hash.
    """
    found = decisions(cut(signature(df, id_column, text_column)), runs, fan_in)
    # An id that is never null: the join and the window below then deal rows by the same columns, and texts move once.
    known = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    keep = found.where("kept").select(known(F.col("_id")).alias("_id"), *KEY)
    signed = beside(df, _id=known(F.col(id_column)), _norm=normalised(text_column)).select("_row", "_id", *signed_columns())
    one = W.partitionBy("_id", *KEY).orderBy(F.xxhash64("_row"))
    return signed.join(keep, ["_id", *KEY], "left_semi").withColumn("_at", F.row_number().over(one)).where("_at = 1").select(*row_columns(df))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT doc_id, sha256(t) AS h, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
