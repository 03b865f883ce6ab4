"""Language identification with string kernels.

The kernel of two texts is the number of hashed character n-grams, of 1 to
``Settings.longest`` letters, that both have, over the geometric mean of the numbers
they have: the blended spectrum kernel on presence, normalised. Landmark texts give
a Nyström approximation of it, in which one ridge regression for each language
against the rest is solved exactly. Scoring is two matrix products a batch: texts by
landmarks, landmarks by languages.

Fitted on a bounded sample: ``Settings.per_language`` rows a language and
``Settings.sample_rows`` in all, those whose ids have the smallest hashes. Scoring
reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from quadrille.llm.common import beside, held_out, row_columns, table, text_or_empty

letters_of = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"
#: Parts that a language's rows are dealt to for the sample.
PARTS = 60


@dataclass(frozen=True)
class Settings:
    per_language: int = 600
    sample_rows: int = 6000
    landmarks: int = 192
    buckets: int = 1 << 14
    longest: int = 3
    ridge: float = 1e-3
    #: Characters whose n-grams are hashed at a time, and texts in a matrix.
    chunk: int = 1 << 20
    batch: int = 128


def presence(text: str, s: Settings) -> np.ndarray:
    """Which buckets the n-grams of a text's letters fall in; words are set apart by a space.
    All false for a text without letters."""
    has = np.zeros(s.buckets, bool)
    letters = " ".join(letters_of(text.lower()))
    if not any(c.isalpha() for c in letters):
        return has
    shift = np.uint64(64 - (s.buckets - 1).bit_length())
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), s.chunk):
        part = codes[at : at + s.chunk + s.longest - 1].astype(np.uint64)
        gram = np.zeros(len(part), np.uint64)
        for n in range(1, s.longest + 1):
            gram = gram[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            has[(gram * np.uint64(0x9E3779B97F4A7C15)) >> shift] = True
    return has


def normalised(rows: np.ndarray) -> np.ndarray:
    """Rows over the root of what they have, so that their products are the kernel."""
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    settings: Settings

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """A value for each row and language, around -1 for no and 1 for yes."""
        return normalised(rows) @ self.landmarks.T @ self.weights


def fit_rows(rows: np.ndarray, languages: list[str], s: Settings) -> Model:
    """Rows of presence and their languages; landmarks are taken in turns from the languages."""
    names = sorted(set(languages))
    turn, seen = [], dict.fromkeys(names, 0)
    for language in languages:
        turn.append(seen[language])
        seen[language] += 1
    x = normalised(rows)
    landmarks = x[np.argsort(turn, kind="stable")[: s.landmarks]]
    value, vector = np.linalg.eigh(landmarks.astype(float) @ landmarks.T.astype(float))
    kept = value > 1e-6 * max(value.max(initial=0), 1e-12)
    root = vector[:, kept] / np.sqrt(value[kept])
    z = (x @ landmarks.T).astype(float) @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Every language counts alike, however many rows it has.
    weight = np.array([1 / seen[language] for language in languages])[:, None] / len(names)
    solved = np.linalg.solve(z.T @ (z * weight) + s.ridge * np.eye(z.shape[1]), z.T @ (y * weight))
    return Model(names, landmarks, (root @ solved).astype(np.float32), s)


def fit(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", settings: Settings = Settings()) -> Model | None:
    """Fit on df's rows with a language and a letter; None if there are none.

    Rows that repeat id and language, null ids included, count once: of their presence
    rows the smallest is taken.
    """
    s = settings
    named = df.where(F.col(language_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(language_column).alias("_language"), F.xxhash64(id_column).alias("_hash")).distinct()
    # As many from each of PARTS parts of a language, dealt by the hash, so that no task has a whole language.
    part = W.partitionBy("_language", F.pmod("_hash", F.lit(PARTS))).orderBy("_hash", "_id")
    first = named.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= -(-s.per_language // PARTS))
    sample = first.orderBy("_n", "_language", "_hash", "_id").limit(s.sample_rows).select("_id", "_language")

    def compute(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, s.batch):
                part = batch.slice(at, s.batch)
                bits = [np.packbits(presence(t.as_py(), s)).tobytes() for t in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(bits, pa.binary())], ["_id", "_language", "_bits"])

    texts = df.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("_of"), F.col(language_column).alias("_lang"), F.col(text_column).alias("_text"))
    chosen = texts.join(F.broadcast(sample), F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_lang") == F.col("_language"))).select("_id", "_language", "_text")  # sample_rows ids at most
    made = chosen.mapInArrow(compute, T.StructType([chosen.schema["_id"], chosen.schema["_language"], T.StructField("_bits", T.BinaryType())]))
    once = made.groupBy("_id", "_language").agg(F.min("_bits").alias("_bits"))  # sample_rows rows at most
    found = sorted((r["_language"], bytes(r["_bits"])) for r in once.collect())
    found = [(language, bits) for language, bits in found if any(bits)]
    if not found:
        return None
    rows = np.unpackbits(np.frombuffer(b"".join(bits for _, bits in found), np.uint8).reshape(len(found), -1), axis=1, count=s.buckets)
    return fit_rows(rows, [language for language, _ in found], s)


def predict(df: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1) for each row, in place of columns of these names.

    und, with score 0, if the text is null or has no letter, or nothing was learned.
    Repeated rows are predicted alike, each for itself; an empty table gives an empty result.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # landmarks x buckets numbers

    def run(batches):
        m = sent.value
        rows_at_once = m.settings.batch if m else 4096
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                named, sure = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
                if m:
                    rows = np.stack([presence(t.as_py(), m.settings) for t in part.column(1)])
                    values = m.scores(rows)
                    for i in np.flatnonzero(rows.any(1)):
                        best = int(values[i].argmax())
                        named[i], sure[i] = m.languages[best], float(min(1, max(0, (values[i, best] + 1) / 2)))
                yield pa.record_batch([part.column(0), pa.array(named, pa.string()), pa.array(sure, pa.float64())], ["_row", "_named", "_sure"])

    rows = beside(df, _text=text_or_empty(text_column))
    found = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_named", T.StringType()), T.StructField("_sure", T.DoubleType())]))
    return found.select(*row_columns(df, ("lang_pred", "score")), F.col("_named").alias("lang_pred"), F.col("_sure").alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(~held_out()))
    return predict(documents.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
