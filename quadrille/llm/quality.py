"""Quality rules with robust multivariate outliers.

Each text gets statistics, and a vector of transformed ones: log length, log mean
word length, and the roots of the shares of symbols, repeated lines and repeated
words. For each language and source the minimum covariance determinant estimate of
their centre and scatter is taken over all texts that pass the base rules, and a
text is rejected if its squared Mahalanobis distance is over a cutoff.

Vectors lie on a grid, some tenth of the least standard deviations apart. So texts are
counted by group and grid point once, and everything after works on these counts: how
many there are depends on the range of the statistics, not on the number of texts.

The estimate starts from two deterministic places (in the manner of DetMCD: Hubert,
Rousseeuw and Verdonck, 2012): medians with quartile distances, and the plain mean
and covariance. Each concentration step takes the distances of all texts, the
``share`` of them with the smallest, and their mean and covariance; of all steps from
both starts the estimate with the smallest determinant is used, scaled so that the
median distance is that of a normal distribution. A step is one aggregation by group
and distance bin, with sums of whole numbers (so it gives the same result in any
order), and a running sum over a group's bins: no group is gathered in one task.

A group's start goes on as long as a step lowers the logarithm of the root of its
determinant by ``change`` or more, then it rests. Floors bound determinants from below, so
steps end by themselves; there is no bound on their number. A covariance is drawn to a
fixed, wide one as if ``prior`` more texts had it: one rule for groups of every size,
by which a group of few texts rejects next to nothing and a large one goes by its own
texts. A floor is added to the variances, so that a statistic that is zero for most
texts of a group does not reject every other text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quadrille.llm.common import SPACE, WORD, beside, fresh_path, remove, row_columns, table, text_or_empty, written

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Settings:
    share: float = 0.75
    #: A start rests once a step lowers the logarithm of its determinant's root by less than this.
    change: float = 0.001
    prior: float = 50.0
    #: Standard deviations, in thousandths, of the fixed covariance.
    wide: tuple[float, ...] = (1000.0, 200.0, 100.0, 300.0, 300.0)
    cutoff: float = 60.0
    #: Standard deviations, in thousandths, that each transformed statistic has at least.
    floors: tuple[float, ...] = (200.0, 50.0, 35.0, 140.0, 180.0)
    #: Distances of grid points, in thousandths.
    grid: tuple[int, ...] = (20, 5, 4, 14, 18)


#: The median of a chi-squared variable with 5 degrees of freedom.
MEDIAN_5 = 4.3515


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """How many words are in a window of three that the array has twice or more.

    Windows are told apart by a 64-bit hash of their words. Sorting them with their
    places brings equal ones together, in n log n steps.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def places(in_order: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(in_order, k)["h"] == x["h"], F.lit(False))
        twice = F.transform(F.filter(in_order, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])
        return _let(twice, lambda t: F.size(F.array_distinct(F.concat(t, F.transform(t, lambda i: i + 1), F.transform(t, lambda i: i + 2)))))

    def count(h: Column) -> Column:
        in_order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(in_order, places))

    return F.when(n < 4, 0).otherwise(_let(hashes, count))


def statistics(df: DataFrame, text_column: str = "text") -> DataFrame:
    """df without its text, with the STATISTICS and n_lines (lines with a word), all long, in place of columns of these names.

    A null or blank text has none of anything. Words are stretches without white space,
    lines are parted by line feeds and equal only if all their characters are.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    text = F.col("_text")
    rows = beside(df, _text=text_or_empty(text_column)).withColumn("_trimmed", F.btrim("_text", F.lit(" \t\n\x0b\f\r")))
    rows = rows.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE, -1)))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    return rows.select(
        *row_columns(df, (text_column, *made)),
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _vector(s: Settings) -> list[Column]:
    """The transformed statistics, in thousandths, on the grid."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [F.log1p(F.col("n_words")), F.log(F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(1000 * v / step).cast("long") * step for v, step in zip(values, s.grid)]


D = 5
X = [f"_x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
SUMS = [f"_s{i}" for i in range(D)] + [f"_p{i}{j}" for i, j in PAIRS]


def _sums() -> list[Column]:
    """Of counted vectors: the count, and the sums of their elements and of the products of these."""
    one = [F.sum(F.col("_times") * F.col(x)).alias(f"_s{i}") for i, x in enumerate(X)]
    return [F.sum("_times").alias("_n"), *one, *[F.sum(F.col("_times") * F.col(X[i]) * F.col(X[j])).alias(f"_p{i}{j}") for i, j in PAIRS]]


def _scatter(sums: DataFrame, s: Settings, keep: list[str]) -> DataFrame:
    """Of each row's counts and sums: means _m, the Cholesky factor _l of the covariance, log determinant _det of that.

    It is one selection, in which later columns refer to earlier ones.
    """
    columns = [f"_s{i} / _n AS _m{i}" for i in range(D)]
    for i, j in PAIRS:
        prior, floor = (s.prior * s.wide[i] ** 2, s.floors[i] ** 2) if i == j else (0.0, 0.0)
        cov = f"(_p{i}{j} - _n * _m{i} * _m{j} + {prior}D) / (_n + {s.prior}D) + {floor}D"
        rest = " - ".join([cov, *[f"_l{i}{k} * _l{j}{k}" for k in range(j)]])
        columns.append(f"sqrt(greatest({rest}, 1e-6D)) AS _l{i}{i}" if i == j else f"({rest}) / _l{j}{j} AS _l{i}{j}")
    return sums.selectExpr(*keep, *columns, " + ".join(f"ln(_l{i}{i})" for i in range(D)) + " AS _det")


ESTIMATE = [f"_m{i}" for i in range(D)] + [f"_l{i}{j}" for i, j in PAIRS] + ["_det"]


def _with_distance(rows: DataFrame) -> DataFrame:
    """rows with the squared distance _d2, by forward substitution in the Cholesky factor."""
    ahead = [" - ".join([f"_x{i} - _m{i}", *[f"_l{i}{k} * _y{k}" for k in range(i)]]) for i in range(D)]
    made = rows.selectExpr("*", *[f"({x}) / _l{i}{i} AS _y{i}" for i, x in enumerate(ahead)], " + ".join(f"_y{i} * _y{i}" for i in range(D)) + " AS _d2")
    return made.drop(*[f"_y{i}" for i in range(D)])


def _bin() -> Column:
    return F.floor(F.log1p("_d2") * 48).cast("int")


def _concentrate(counted: DataFrame, estimates: DataFrame, s: Settings) -> DataFrame:
    """One step for each group and start: the estimate from the texts that are nearest by the last one, and _was, its determinant."""
    keys = ["_g", "_start", "_total", "_was"]
    by_bin = _with_distance(counted.join(estimates.withColumnRenamed("_det", "_was"), "_g")).groupBy(*keys, _bin().alias("_bin")).agg(*_sums())
    so_far = W.partitionBy("_g", "_start").orderBy("_bin")
    run = by_bin.select(*keys, *[F.sum(c).over(so_far).alias(c) for c in ("_n", *SUMS)], F.col("_n").alias("_own"))
    enough = F.ceil(F.col("_total") * s.share)
    nearest = run.where((F.col("_n") >= enough) & (F.col("_n") - F.col("_own") < enough))
    return _scatter(nearest, s, keys)


def _starts(counted: DataFrame, s: Settings) -> DataFrame:
    """The two estimates of each group from which steps begin. They are not results: their determinants count as infinite."""
    plain = counted.groupBy("_g").agg(*_sums()).withColumn("_total", F.col("_n")).withColumn("_start", F.lit(0))
    quartiles = [F.percentile(x, [0.25, 0.5, 0.75], F.col("_times")).alias(f"_q{i}") for i, x in enumerate(X)]
    medians = counted.groupBy("_g").agg(F.sum("_times").alias("_total"), *quartiles)
    spread = lambda i: F.greatest((F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]) / 1.349, F.lit(s.floors[i]))
    factor = [(spread(i) if i == j else F.lit(0.0)).alias(f"_l{i}{j}") for i, j in PAIRS]
    robust = medians.select("_g", F.lit(1).alias("_start"), "_total", *[F.col(f"_q{i}")[1].alias(f"_m{i}") for i in range(D)], *factor, F.lit(0.0).alias("_det"))
    return _scatter(plain, s, ["_g", "_start", "_total"]).unionByName(robust).withColumn("_det", F.lit(float("inf")))


def estimates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The estimate of each group _g of rows (_g and the vector _x0.._x4): means, Cholesky factor, _scale of squared
    distances. No rows give no estimates.

    Each step is written to the shared folder, so that the next one sees its size and joins it by a broadcast if it is
    small, else by a shuffle. These tables are removed at the end.
    """
    s, spark = settings, rows.sparkSession
    folder = fresh_path(spark, "steps")
    counted = written(rows.groupBy("_g", *X).agg(F.count(F.lit(1)).alias("_times")), f"{folder}/counted")
    going, taken = written(_starts(counted, s), f"{folder}/starts"), []
    while not taken or going.take(1):
        taken.append(f"{folder}/{len(taken)}")
        now = written(_concentrate(counted, going, s).withColumn("_step", F.lit(len(taken))), taken[-1])
        going = now.where(F.col("_det") <= F.col("_was") - s.change).drop("_was", "_step")
    best = F.row_number().over(W.partitionBy("_g").orderBy("_det", "_start", "_step"))
    chosen = spark.read.schema(now.schema).parquet(*taken).withColumn("_best", best).where("_best = 1").select("_g", "_total", *ESTIMATE)
    chosen = written(chosen, f"{folder}/chosen")
    counts = _with_distance(counted.join(chosen, "_g")).groupBy("_g", "_total", _bin().alias("_bin")).agg(F.sum("_times").alias("_n"))
    half = counts.withColumn("_so_far", F.sum("_n").over(W.partitionBy("_g").orderBy("_bin"))).where(2 * F.col("_so_far") >= F.col("_total"))
    scale = half.groupBy("_g").agg((F.greatest(F.expm1((F.min("_bin") + 0.5) / 48), F.lit(MEDIAN_5)) / MEDIAN_5).alias("_scale"))
    found = written(chosen.join(scale, "_g").select("_g", *ESTIMATE, "_scale"), fresh_path(spark, "estimates"))
    remove(spark, folder)
    return found


def quality(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", by: tuple[str, ...] = ("lang", "source"), settings: Settings = Settings()) -> DataFrame:
    """The statistics of each row of df, base_failed, distance (null where no text of the group passed the base rules) and kept.

    Nulls in the columns by are a value of their own. Repeated ids are rows of their
    own; an empty table gives an empty result.
    """
    spark, s = df.sparkSession, settings
    keys = [F.col(c).cast("string").alias(f"by{i}") for i, c in enumerate(by)]
    named = df.select(F.col(id_column).alias("_id"), F.to_json(F.struct(*keys)).alias("_g"), F.col(text_column).alias("_read"))
    measured = statistics(named, "_read")
    rows = written(measured.select("*", base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), *[v.alias(x) for v, x in zip(_vector(s), X)]), fresh_path(spark, "statistics"))
    found = estimates(rows.where(~F.col("base_failed")).select("_g", *X), s)
    judged = _with_distance(rows.join(found, "_g", "left"))
    distance = F.col("_d2") / F.col("_scale")
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= s.cutoff)
    return judged.select(F.col("_id").alias(id_column), *STATISTICS, "base_failed", distance.alias("distance"), kept.alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *STATISTICS, "base_failed", "kept", "distance")
