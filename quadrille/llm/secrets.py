"""Secret scans with an incremental blob ledger.

A text is a blob, addressed by its SHA-256; the rows that hold it are its paths.
The ledger is a table with one row (_blob, rule_version, findings) for every blob
that was scanned under a version of the rules, also for blobs without findings. The
version is made of the rules themselves, so that other rules never find old results.
A scan takes the blobs of all rows, leaves out those that the ledger has under
the same version, scans one copy of each of the rest, appends them to the
ledger and joins the findings back to all paths. An append that is repeated, or that two
scans make at the same time, does no harm: the ledger is read with each blob once.

Spans come from two expressions on the text: the matches, and the stretches
between matches; their running lengths give the places, in code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from quadrille.llm.common import looked_up, beside, cut, fresh_path, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count if their group has least or more characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The kinds of secrets, in their order. A run of hex digits or of an
#: access key is as long as it can be, so its least length is part of the pattern;
#: an assignment's is not, as a short value is passed over together with its name.
RULES = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")
#: To be changed if find() comes to see rules in another way.
VERSION = "1"

#: What may stand between the parts of a key: white space, also as escapes in a string, and marks of quotes.
_GAP = r"""(?:\\[nrt]|[\s>"',|*#])"""
_LINE_END = r"""(?:\\[nr]|[\r\n])"""
#: A private key as a whole: from BEGIN to its END, or, where that is missing, over header fields, base64
#: lines and a last line that is shorter. Repeats are possessive, so that long texts take one pass.
PEM_BLOCK = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):\x20*+[^\s\\]++)*+(?:{_GAP}*+[A-Za-z0-9+/]{{24,}}+={{0,2}}+)*+"
    rf"(?:\x20*+{_LINE_END}{_GAP}*+[A-Za-z0-9+/]++={{0,2}}+(?=[\x20\t\x22',]*+(?:{_LINE_END}|\z)))?+)"
)
#: The rules to redact by: they cover all of a secret, where RULES may tell no more than where it begins.
WHOLE = tuple(Rule("pem", PEM_BLOCK) if r.kind == "pem" else r for r in RULES)


def version_of(rules: tuple[Rule, ...], version: str = VERSION) -> str:
    """What the ledger knows these rules by."""
    return f"{version} {hashlib.sha256(repr(rules).encode()).hexdigest()[:16]}"


FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("clear_from", T.LongType())]))


def _blob(text_column: str) -> Column:
    # Told not to be null, so that joins don't compute it a second time to find out.
    return F.coalesce(F.unhex(F.sha2(text_or_empty(text_column).cast("binary"), 256)), F.lit(b""))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.char_length(x).cast("long"))


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For blobs (_blob, _text): _blob and its findings, sorted by start and kind.

    A finding has start, end (exclusive), the rule's place in rules, and clear_from:
    the largest end before it, 0 for the first. Blobs without findings have no row.
    """
    found = []
    for k, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        whole = F.regexp_extract_all("_text", pattern, F.lit(0))
        held = F.regexp_extract_all("_text", pattern, F.lit(rule.group)) if rule.group else whole
        between = F.split("_text", rule.pattern, -1)
        found.append(F.when(F.col("_text").rlike(rule.pattern), F.arrays_zip(_lengths(whole).alias("size"), _lengths(held).alias("held"), F.slice(_lengths(between), F.lit(1), F.size(whole)).alias("gap"), F.array_repeat(F.lit(k), F.size(whole)).alias("kind"))))
    lengths = blobs.select("_blob", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("_kinds"))
    # A blob that came twice has the same lengths twice. No filter on them stands before the
    # grouping, as it would be moved to where all texts are read, past the ledger.
    once = lengths.groupBy("_blob").agg(F.first("_kinds").alias("_kinds"))
    parts = once.select("_blob", F.explode("_kinds").alias("_of_kind")).select("_blob", F.posexplode("_of_kind").alias("_at", "_m"))
    so_far = W.partitionBy("_blob", "kind").orderBy("_at")
    places = parts.select("_blob", "_at", "_m.*").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    before = W.partitionBy("_blob").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    kept = places.where(F.col("held") >= least).withColumn("clear_from", F.coalesce(F.max("end").over(before), F.lit(0)))
    return kept.groupBy("_blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "clear_from"))).alias("findings"))


def scan(df: DataFrame, ledger: str, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Bring the ledger (a Parquet folder) up to date with df and return what it has under these rules.

    Returns _blob and findings (array, may be empty) for each blob that was scanned, of
    df or before. Null and empty texts are one blob, without findings. Rows that repeat
    a text are one blob; an empty table adds nothing.
    """
    spark, known_by = df.sparkSession, version_of(rules, version)
    paths = df.select(F.col(id_column).alias("_path"), _blob(text_column).alias("_blob"))
    blobs = paths.groupBy("_blob").agg(F.min("_path").alias("_path"))
    known = _ledger(spark, ledger)
    if known is not None:
        blobs = blobs.join(known.where(F.col("rule_version") == known_by), "_blob", "left_anti")
    unseen = cut(blobs)
    texts = df.select(F.col(id_column).alias("_of"), text_or_empty(text_column).alias("_text"), _blob(text_column).alias("_digest"))
    one = texts.join(unseen, (texts["_digest"] == unseen["_blob"]) & texts["_of"].eqNullSafe(unseen["_path"]), "left_semi").select(F.col("_digest").alias("_blob"), "_text")
    rows = unseen.select("_blob").join(find(one, rules), "_blob", "left").select("_blob", F.lit(known_by).alias("rule_version"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
    rows.write.mode("append").parquet(ledger)
    return _ledger(spark, ledger).where(F.col("rule_version") == known_by).select("_blob", "findings").dropDuplicates(["_blob"])


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger as it is, blobs that were appended twice included; None if there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    schema = T.StructType([T.StructField("_blob", T.BinaryType()), T.StructField("rule_version", T.StringType()), T.StructField("findings", FINDINGS)])
    return spark.read.schema(schema).parquet(path)


def findings_by_path(df: DataFrame, ledger: str, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """A row for each row of df: its id and the findings in its text."""
    seen = scan(df, ledger, id_column, text_column, rules, version)
    paths = df.select(F.col(id_column).alias("_path"), _blob(text_column).alias("_blob"))
    return looked_up(paths, seen.where(F.size("findings") > 0), "_blob", "_path", how="left").select(F.col("_path").alias(id_column), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def redact(df: DataFrame, ledger: str, id_column: str = "doc_id", text_column: str = "text", mark: str = "[REDACTED]", rules: tuple[Rule, ...] = WHOLE, version: str = VERSION) -> DataFrame:
    """df with each finding, or stretch of overlapping findings, replaced by mark; of a private key, the whole block.

    Texts without findings, null ones included, stay as they are. Other columns are
    not changed.
    """
    seen = scan(df, ledger, id_column, text_column, rules, version).where(F.size("findings") > 0).select(F.col("_blob").alias("_key"), F.col("findings").alias("_findings"))
    joined = looked_up(beside(df, _key=_blob(text_column), _id=F.col(id_column)), seen, "_key", "_id", how="left")
    text = F.col("_row").getField(text_column)
    clear = lambda x: F.when(x["start"] >= x["clear_from"], F.concat(F.substring(text, x["clear_from"].cast("int") + 1, (x["start"] - x["clear_from"]).cast("int")), F.lit(mark))).otherwise("")
    tail = F.substring(text, F.array_max(F.transform("_findings", lambda x: x["end"])).cast("int") + 1, F.lit(2147483647))
    cleared = F.when(F.col("_findings").isNull(), text).otherwise(F.concat(F.array_join(F.transform("_findings", clear), ""), tail))
    return joined.select(*[cleared.alias(text_column) if c == text_column else F.col("_row").getField(c).alias(c) for c in df.columns])


def joined_spans(findings: Column, kinds: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the findings of these kinds, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    chosen = F.filter(findings, lambda x: F.element_at(names, x["kind"] + 1).isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings_by_path(table(spark, sf_dir, "documents"), fresh_path(spark, "ledger"))
    found = F.col("findings")
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(joined_spans(found, BASE).cast("binary"), 256).alias("base_sha256"),
        joined_spans(found, tuple(r.kind for r in RULES)).alias("spans"),
    )


def _sql() -> str:
    of_kind = "\nUNION ALL\n".join(
        f"SELECT doc_id, {k} AS o, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, p) AS m, regexp_extract_all(t, p, {r.group}) AS g, string_split_regex(t, p) AS gaps FROM (SELECT doc_id, coalesce(text, '') AS t, '{r.pattern.replace(chr(39), chr(39) * 2)}' AS p FROM documents)"
        for k, r in enumerate(RULES)
    )
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in BASE)
    return f"""
WITH k AS ({of_kind}),
     i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
     s AS (SELECT doc_id, o, kind, least, length(g[i]) AS held, length(m[i]) AS size, length(array_to_string(gaps[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS b FROM i),
     f AS (SELECT doc_id, o, kind, b, kind || ':' || b || ':' || (b + size) AS span FROM s WHERE held >= least),
     a AS (SELECT doc_id, {counts}, string_agg(CASE WHEN kind IN ({base}) THEN span END, ',' ORDER BY b, o) AS base, string_agg(span, ',' ORDER BY b, o) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""


OP1_SQL = _sql()
