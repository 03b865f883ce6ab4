"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's words and their first four and six letters, hashed to buckets.
The buckets that tell the classes apart best are chosen; a second-order
factorization machine (Rendle, 2010) over them learns a weight for each and, through
a short vector for each, an interaction for every pair, so that two terms together
(an insult and whom it is aimed at) can weigh more than the sum of both.

It is fitted on a bounded sample of labelled rows, ``Settings.sample_rows`` at
most, those whose ids have the smallest hashes. Terms are counted by Spark jobs;
what comes to the driver is the chosen buckets and the sample's chosen terms, both
of bounded size. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quadrille.llm.common import beside, cut, held_out, row_columns, table, text_or_empty

#: Words whose buckets a Python worker keeps; when there are more it starts anew.
CACHED_WORDS = 300_000
words_of = re.compile(r"[^\W_]+").findall


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    buckets: int = 1 << 20
    terms: int = 2048
    factors: int = 8
    epochs: int = 15
    batch: int = 256
    rate: float = 0.05
    shrink_weights: float = 1e-4
    shrink_factors: float = 1e-3
    seed: int = 42


def buckets_of(word: str, buckets: int) -> list[int]:
    """The buckets of a word and of its beginnings."""
    terms = [word, *(word[:n] + "*" for n in (4, 6) if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % buckets for t in terms]


class TermCounter:
    """Counts of buckets in texts; chosen gives the buckets that count and their places."""

    def __init__(self, buckets: int, chosen: dict[int, int] | None = None):
        self.buckets, self.chosen = buckets, chosen
        self._known: dict[str, tuple[int, ...]] = {}

    def _places(self, word: str) -> tuple[int, ...]:
        found = buckets_of(word, self.buckets)
        places = tuple(found if self.chosen is None else (self.chosen[b] for b in found if b in self.chosen))
        self._known[word] = places
        return places

    def count(self, text: str) -> Counter:
        if len(self._known) > CACHED_WORDS:
            self._known.clear()
        known, out = self._known.get, Counter()
        for word, n in Counter(words_of(text.lower())).items():
            places = known(word)
            for place in self._places(word) if places is None else places:
                out[place] += n
        return out


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int, s: Settings) -> FactorizationMachine:
        """Logistic loss, AdaGrad on batches. rows: places and values of each row's terms."""
        rng = np.random.default_rng(s.seed)
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
        m = cls(math.log(share / (1 - share)), np.zeros(terms), rng.normal(0, 0.02, (terms, s.factors)))
        seen = [np.full(1, 1e-6), np.full(terms, 1e-6), np.full((terms, s.factors), 1e-6)]
        for _ in range(s.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), s.batch):
                part = order[at : at + s.batch]
                x = np.zeros((len(part), terms))
                for i, k in enumerate(part):
                    x[i, rows[k][0]] = rows[k][1]
                mixed = x @ m.factors
                error = (m._probability(x, mixed) - labels[part]) / len(part)
                by_weight = x.T @ error + s.shrink_weights * m.weights
                by_factor = x.T @ (error[:, None] * mixed) - (np.square(x).T @ error)[:, None] * m.factors + s.shrink_factors * m.factors
                for value, slope, sum_of in ((m.weights, by_weight, seen[1]), (m.factors, by_factor, seen[2])):
                    sum_of += np.square(slope)
                    value -= s.rate * slope / np.sqrt(sum_of)
                seen[0] += error.sum() ** 2
                m.bias -= s.rate * error.sum() / math.sqrt(seen[0][0])
        return m

    def _probability(self, x: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        pairs = 0.5 * (np.square(mixed).sum(1) - np.square(x) @ np.square(self.factors).sum(1))
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights + pairs, -30, 30)))

    def probability(self, places: np.ndarray, values: np.ndarray) -> float:
        """The score of one row, from its terms alone."""
        v = self.factors[places]
        pairs = 0.5 * (np.square(values @ v).sum() - np.square(values) @ np.square(v).sum(1))
        return 1 / (1 + math.exp(-min(30, max(-30, self.bias + values @ self.weights[places] + pairs))))


@dataclass
class Model:
    machine: FactorizationMachine
    chosen: dict[int, int]
    settings: Settings


def _values(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", settings: Settings = Settings()) -> Model:
    """Fit on the documents that labels has a label for. Rows of null id or null label are left out;
    a repeated id counts once, by its largest label and by the first of its texts' term lists in order.
    Without any label, or any document, the score is 0.5 for every text."""
    s = settings
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label_column).cast("int")).alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(s.sample_rows)
    texts = documents.select(F.col(id_column).alias("_of"), text_or_empty(text_column).alias("_text"))
    labelled = texts.join(F.broadcast(sample), F.col("_of") == F.col("_id")).select("_id", "_y", "_text")  # sample_rows ids at most

    def count(batches):
        counter = TermCounter(s.buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [counter.count(x.as_py()) for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["_id", "_y", "_terms", "_counts"])

    kind = labelled.schema["_id"].dataType.simpleString()
    counted = cut(labelled.mapInArrow(count, f"_id {kind}, _y int, _terms array<int>, _counts array<int>"))
    found, ids = counted.agg(F.count(F.lit(1)), F.count_distinct("_id")).first()
    if found > ids:  # only then term lists are shuffled
        once = counted.groupBy("_id", "_y").agg(F.min(F.struct("_terms", "_counts")).alias("_found"))
        counted = cut(once.select("_id", "_y", "_found.*"))  # sample_rows rows at most
    rows, toxic = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    # The G statistic of each bucket's presence against the label, from its counts in both classes.
    of_term = counted.select("_y", F.explode("_terms").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n1")).where("n >= 3")
    told = F.lit(0.0)
    for both, one in ((F.col("n"), F.col("n1")), (rows - F.col("n"), toxic - F.col("n1"))):
        for got, share in ((one, toxic), (both - one, rows - toxic)):
            told = told + F.when(got > 0, got * F.log(got * float(rows) / (both * float(max(share, 1))))).otherwise(0.0)
    chosen = {r[0]: i for i, r in enumerate(of_term.select("_t", told.alias("g")).orderBy(F.desc("g"), "_t").limit(s.terms).select("_t").collect())}

    def keep(batches):
        for batch in batches:
            terms, counts = [], []
            for t, c in zip(batch.column(2), batch.column(3)):
                here = [(chosen[a], b) for a, b in zip(t.as_py(), c.as_py()) if a in chosen]
                terms.append([a for a, _ in here])
                counts.append([b for _, b in here])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["_id", "_y", "_terms", "_counts"])

    design = sorted(((r["_id"], r["_y"], r["_terms"], r["_counts"]) for r in counted.mapInArrow(keep, counted.schema).collect()), key=repr)
    data = [(np.array(t, np.int64), _values(np.array(c, float))) for _, _, t, c in design]
    return Model(FactorizationMachine.fit(data, np.array([y for _, y, _, _ in design], float), max(len(chosen), 1), s), chosen, s)


def score(df: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """df with a score from 0 to 1 for each row, in place of a column of that name; null texts count as empty, and an empty text
    scores the share of label 1 as the machine's bias has it. Repeated rows score alike, each for itself; an empty table gives
    an empty result."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: settings.terms rows

    def run(batches):
        m = sent.value
        counter = TermCounter(m.settings.buckets, m.chosen)
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = counter.count(text.as_py())
                out.append(m.machine.probability(np.array(list(found), np.int64), _values(np.array(list(found.values()), float))))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], ["_row", "_score"])

    rows = beside(df, _text=text_or_empty(text_column))
    scored = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_score", T.DoubleType())]))
    return scored.select(*row_columns(df, (score_column,)), F.col("_score").alias(score_column))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(documents.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
