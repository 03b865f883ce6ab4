"""Fill-in-middle: texts cut into prefix, middle and suffix, put in another order behind marks.

A text is a sequence of units: a word with the white space before it, or the white
space at the end. ``regexp_count`` gives their number n, two hashes of the row's id
the cuts a <= b, and one match of a pattern made for the row does the rest: its groups
are a units, b - a units and what is left, and the replacement puts them in order.
The counted repeats are possessive, so the match never goes back and needs neither a
stack nor memory that grows with the counts. All of it runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.llm.common import beside, row_columns, table, text_or_empty

#: A unit; its own repeats are possessive, as no shorter match of them can be right.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Settings:
    """seed goes into the hash of an id; of a hundred texts rate are cut, and of a hundred cut ones spm_rate have the suffix first."""

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id; a null id hashes like an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(_row, n, form, prefix_units, middle_units, output) for each row of docs, whose columns are in the struct _row.

    form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle). Texts that are
    empty or null, or hold one of the marks, are plain and go out as they are, as do those that the rate
    leaves out. Rows are handled each by itself: repeated ones stay, an empty table gives none.
    """
    rows = beside(docs, _text=text_or_empty(text_column), _h=F.array(*hashes(F.col(id_column), settings.seed)))
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    one, two = [F.col("_h")[i] % (F.col("n") + 1) for i in (0, 1)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.col("_text").contains(mark)
    plain = (F.col("_text") == "") | marked | (F.col("_h")[2] % 100 >= settings.rate)
    form = F.when(plain, "plain").when(F.col("_h")[3] % 100 < settings.spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "_first": F.least(one, two), "_second": F.abs(one - two)})
    first, second = F.col("_first"), F.col("_second")
    pattern = F.format_string(rf"(?s)\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)(.*+)\z", first, second)
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select("_row", "n", "form", cut_only(first).alias("prefix_units"), cut_only(second).alias("middle_units"), output.alias("output"))


def parts(form: Column, output: Column) -> Column:
    """(prefix, middle, suffix) of an output as a struct; null if it is plain. The text itself holds no marks, so each is
    found where it first stands."""
    at = lambda mark: F.instr(output, mark)
    between = lambda start, end: F.substring(output, start + 3, end - start - 3)
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    prefix = F.when(form == "psm", between(p, s)).otherwise(between(p, m))
    suffix = F.when(form == "psm", between(s, m)).otherwise(between(s, p))
    middle = F.substring(output, m + 3, F.char_length(output))
    return F.when(form != "plain", F.struct(prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix")))


def restored(form: Column, found: Column, output: Column) -> Column:
    """The text again, from an output and its parts."""
    return F.when(form == "plain", output).otherwise(F.concat(found["prefix"], found["middle"], found["suffix"]))


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs with the text column transformed, and form; other columns stay as they are, but for one named form."""
    made = transform(docs, id_column, text_column, settings)
    kept = [c.alias(n) if n != text_column else F.col("output").alias(n) for n, c in zip([n for n in docs.columns if n != "form"], row_columns(docs, ("form",)))]
    return made.select(*kept, "form")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.withColumn("_parts", parts(F.col("form"), F.col("output")))
    size = lambda part: F.char_length(F.col("_parts")[part]).cast("long")
    return made.select(
        F.col("_row")["doc_id"].alias("doc_id"),
        "n",
        "form",
        size("prefix").alias("prefix_chars"),
        size("middle").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("_parts"), F.col("output")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS v FROM d),
c AS (SELECT *, least(v[1] % (len(u) + 1), v[2] % (len(u) + 1)) AS a, greatest(v[1] % (len(u) + 1), v[2] % (len(u) + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR v[3] % 100 >= 50 THEN 'plain' WHEN v[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
