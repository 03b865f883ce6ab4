"""A corpus pipeline: each stage is one of the training-data operators, on what the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.llm import exact_dedup, packing, secrets, simhash, toxicity
from quadrille.llm.common import beside, fresh_path, held_out, remove, row_columns, table, written

#: Folder of a ledger of secrets that is kept from run to run, so that texts that were scanned before are
#: not scanned again; if there is none, each run has one of its own.
LEDGER: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject. It learns from the labels that are not held out.

    Null and empty texts score alike, by the share of toxic labels. Repeated rows stay or go together. Without
    labels, or documents that have one, all stay. An empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(beside(docs, text=F.col("text")), model)
    return scored.where(F.col("score") < 0.5).select(*row_columns(docs))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts that with the smallest id.

    Null and empty texts are equal. A null id counts as larger than any other. Of rows that repeat id and text
    one stays. An empty table stays empty.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Texts without words, null ones included, are near duplicates of each other. A null id counts as larger than any
    other. Rows that repeat id and text stay or go together. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars counted again.

    Null and empty texts stay as they are, with the n_chars that they had. Repeated rows stay. An empty table stays empty.
    """
    clean = secrets.redact(docs, LEDGER or fresh_path(spark, "ledger"))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 tokens.

    A null or empty text is one piece of one token. Rows that repeat an id are documents of their own. Other columns
    of docs are left out. An empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("secret scan", redact_secrets),
    ("best-fit packing", pack),
]

#: SQL cannot express the model of the first stage and the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is removed once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
