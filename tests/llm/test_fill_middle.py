"""Fill-in-middle against a plain version, on all cases of rows.py and on texts with marks."""

import hashlib
import re

from pyspark.sql import functions as F

from quadrille.llm import fill_middle as M
from tests.llm.rows import ROWS, clashing, empty

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def found(df, **settings):
    made = M.transform(df, settings=M.Settings(**settings))
    made = made.withColumn("_p", M.parts(F.col("form"), F.col("output")))
    back = M.restored(F.col("form"), F.col("_p"), F.col("output"))
    return made.select(F.col("_row")["doc_id"], F.col("_row")["text"], "n", "form", F.char_length("_p.prefix"), F.char_length("_p.middle"), "output", back).collect()


def test_all_cases(spark):
    rows = found(clashing(spark), rate=100)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert tuple(r[2:7]) == plain(r[0], r[1], rate=100)
        assert r[7] == (r[1] or "")


def test_marks_dollars_emoji_and_long_texts(spark):
    texts = ["a <P> b", "<S>", "x<M>y", "$1 \\2 ${a} cost $5 and\n\nmore \\n", "🙂 🙂🙂\t日本 語 é", " \n\t", "word " * 60_000, "x" * 200_000, " " * 100_000, "a" + " " * 50_000 + "b", "<p> < P> <PP>", "\r\n a \x0b b \x0c c \x85 d   e"]
    df = spark.createDataFrame([(i * 31 + j, t) for i in range(12) for j, t in enumerate(texts)], "doc_id bigint, text string")
    rows = found(df, rate=100)
    assert len(rows) == df.count()
    for r in rows:
        assert tuple(r[2:7]) == plain(r[0], r[1], rate=100)
        assert r[7] == r[1]
    assert {r[3] for r in rows} == {"plain", "psm", "spm"}


def test_rate_and_columns(spark):
    df = clashing(spark).withColumn("form", F.lit("mine"))
    out = M.fill_in_middle(df, settings=M.Settings(rate=0))
    assert out.columns == df.columns and {r["form"] for r in out.collect()} == {"plain"}
    assert M.transform(empty(spark)).count() == 0
