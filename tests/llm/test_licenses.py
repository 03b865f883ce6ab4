"""License scan against a plain search of phrases, and licence texts with edits."""

import random
import re

from pyspark.sql import functions as F

from quadrille.llm import licenses as M
from tests.llm.rows import ROWS, clashing, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def plain(text):
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    found = [(m[0], m.span()) for m in WORD.finditer(lower)]
    ws = [w for w, _ in found]
    places = [(label, i, found[i][1][0], found[i + len(p) - 1][1][1]) for label, p in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p)] == p]
    return len(ws), sorted(places, key=lambda x: (x[1], x[0]))


def checked(df):
    rows = M.scan(df).collect()
    for r in rows:
        n, places = plain(r["text"])
        assert r["n_words"] == n
        assert sorted(((m["label"], m["first_word"], m["start"], m["end"]) for m in r["matches"] if m["base"]), key=lambda x: (x[1], x[0])) == places
    return rows


def test_phrases_at_all_places(spark):
    rng = random.Random(3)
    parts = ["cc", "CC", "by", "BY-NC 4.0", "general", "public", "License", "all", "rights", "reserved", "reservedé", "日cc", "🙂", "\n", "-", "All Rights Reserved.", "cc by", "\x00", "İK", "gnu"]
    texts = [rng.choice(["", " ", "_"]).join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["cc by " * 40_000, "x" * 300_000, None, "", "word " * 50_000 + "all rights reserved", "general public license"]
    checked(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))


def test_all_cases_keep_columns(spark):
    df = clashing(spark).withColumn("matches", F.lit("mine"))
    rows = checked(df)
    assert len(rows) == len(ROWS)
    assert M.scan(df).columns == [*[c for c in df.columns if c != "matches"], "n_words", "matches"]
    assert M.scan(empty(spark)).count() == 0


def edited(text, rng, share):
    """The words of text, some replaced, left out or with others put in."""
    out = []
    for w in text.split():
        if rng.random() < share:
            out += rng.choice([[], ["changed"], [w, "added"]])
        else:
            out.append(w)
    return " ".join(out)


def test_licence_texts_with_edits_around_other_text(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["alpha", "license", "software", "the", "copy", "notice", "of", "permission", "version"]) for _ in range(n))
    rows, want = [], {}
    for t in M.NOTICES:
        for copy in range(3):
            text = t.text
            if t.phrases and copy:  # key phrases stay, other words change
                marked = text.lower()
                words = [w.decode() for w in M.words(text)]
                keep = set()
                for p in t.phrases:
                    p = [w.decode() for w in M.words(p)]
                    keep |= {i + j for i in range(len(words)) if words[i : i + len(p)] == p for j in range(len(p))}
                assert keep, marked
                text = " ".join(x for i, w in enumerate(words) for x in ([w] if i in keep or rng.random() > 0.08 else ["changed"]))
            want[len(rows)] = t.label
            rows.append((len(rows), f"{filler(200)}\n{text}\n{filler(50)}"))
    clean = len(rows)
    rows += [(clean + i, filler(2000)) for i in range(20)]
    # The key phrases alone, far apart, and a text without one of them, are no match.
    mit = next(t for t in M.NOTICES if t.label == "mit" and t.phrases)
    rows.append((len(rows), f"{mit.phrases[0]} {filler(300)} {mit.phrases[1]}"))
    rows.append((len(rows), mit.text.replace("free of charge", "for a fee")))
    found = {r["doc_id"]: r["matches"] for r in M.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, label in want.items():
        assert label in {m["label"] for m in found[i]}, rows[i][1]
        assert all(0 < m["score"] <= 1 for m in found[i])
    assert all(not found[i] for i in range(clean, len(rows)))


def test_rare_words_are_those_of_all_documents(spark):
    df = spark.createDataFrame([(i, "cc all all" if i % 2 else "by cc rights") for i in range(100)], "doc_id bigint, text string").repartition(5)
    found, n = M.document_frequency(df, {b"cc", b"by", b"all", b"rights", b"none"})
    assert (found, n) == ({b"cc": 100, b"by": 50, b"all": 50, b"rights": 50}, 100)
    index = M.Index(M.BASE, found, n, M.Settings())
    assert b"by" in index.postings and b"cc" not in index.postings
