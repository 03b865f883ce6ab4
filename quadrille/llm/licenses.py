"""License scan by a positional index of rare words.

Templates are licence texts, notices and phrases, as sequences of words. The index
holds, for the words of a template with the highest IDF over all documents (its
anchors), where they stand in it. A file's words are looked up there; a word at place p
of the file and q of the template says that the template would begin at p - q. Where
enough different anchors agree on that, within the slack that a template allows, the
stretch is verified: its mandatory key phrases must stand in it word for word, and
enough of its words. A phrase is a template without slack whose words are all mandatory;
it is found at every place, as its rarest word stands in each of them.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quadrille.llm.common import row_columns, table, text_or_empty

#: Bytes of text after which a worker gives back a record batch.
BATCH_BYTES = 4 << 20
#: Lower case for A-Z, a space for what is not part of a word; all bytes of characters beyond ASCII are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    """text, whose label it gives; the phrases that must stand in a match word for word, and the share of the words
    that must be there. Without phrases the whole text must."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    share: float = 0.75
    base: bool = False


@dataclass(frozen=True)
class Settings:
    """anchors of a template with phrases, the part of them that must agree, and the slack as a part of its length."""

    anchors: int = 8
    agree: float = 0.5
    slack: float = 0.15


# Phrases and their labels, as dealt.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
# Names by which licences are referred to, and passages of their texts.
NOTICES = (
    Template("mit", "mit license"),
    Template("apache-2.0", "apache license version 2.0"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2.0", "mozilla public license version 2.0"),
    Template("mpl-2.0", "mozilla public license v. 2.0"),
    Template("epl", "eclipse public license"),
    Template("cc-by-sa", "cc by-sa"),
    Template("cc-by-nc", "cc by-nc"),
    Template("cc-by-nd", "cc by-nd"),
    Template("cc-by", "creative commons attribution"),
    Template("cc0", "cc0 1.0"),
    Template("bsd", "bsd license"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted", "permission notice appear in all copies"),
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("under the terms of the gnu general public license as published by the free software foundation", "this program is distributed in the hope that it will be useful"),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        ("in no event will the authors be held liable for any damages arising from the use of this software", "alter it and redistribute it freely"),
    ),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
        ("to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    ),
)


class Index:
    """Postings of the templates' anchors, by the IDF of their words."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int], documents: int, settings: Settings):
        self.templates, self.postings = templates, {}
        self.words = [words(t.text) for t in templates]
        self.phrases = [[b" " + b" ".join(words(p)) + b" " for p in t.phrases] for t in templates]
        self.counts = [Counter(ws) for ws in self.words]
        self.slack, self.need = [], []
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for ws in self.words for w in ws}
        for n, (t, ws) in enumerate(zip(templates, self.words)):
            anchors = sorted(set(ws), key=lambda w: (-self.idf[w], w))[: settings.anchors if t.phrases else 1]
            self.slack.append(max(2, int(settings.slack * len(ws))) if t.phrases else 0)
            self.need.append(max(1, math.ceil(settings.agree * len(anchors))))
            for w in anchors:
                self.postings.setdefault(w, []).append((n, [i for i, x in enumerate(ws) if x == w]))

    def matches(self, file: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, score) of all matches in a file's words."""
        get, begins = self.postings.get, {}
        for p, w in enumerate(file):
            if (found := get(w)) is not None:
                for n, places in found:
                    begins.setdefault(n, []).extend((p - q, w) for q in places)
        out = []
        for n, hits in begins.items():
            out += self._notices(n, hits, file) if self.templates[n].phrases else self._places(n, hits, file)
        return sorted(out, key=lambda m: (m[1], m[0]))

    def _places(self, n: int, hits: list, file: list[bytes]) -> list:
        """Where all words of a phrase follow each other; its anchor may stand in it more than once."""
        ws = self.words[n]
        return [(n, at, at + len(ws), 1.0) for at in sorted({at for at, _ in hits}) if at >= 0 and file[at : at + len(ws)] == ws]

    def _notices(self, n: int, hits: list, file: list[bytes]) -> list:
        """Where enough anchors agree on a beginning, and the stretch from there holds the key phrases and enough words."""
        hits.sort()
        slack, size, out = self.slack[n], len(self.words[n]), []
        first, agreeing, done = 0, Counter(), -math.inf
        for at, w in hits:
            agreeing[w] += 1
            while hits[first][0] < at - slack:
                if agreeing[hits[first][1]] == 1:
                    del agreeing[hits[first][1]]
                else:
                    agreeing[hits[first][1]] -= 1
                first += 1
            begin = hits[first][0]
            if len(agreeing) < self.need[n] or begin < done:
                continue
            start, end = max(0, begin - slack), min(len(file), at + size + slack)
            stretch = file[start:end]
            joined = b" " + b" ".join(stretch) + b" "
            if not all(p in joined for p in self.phrases[n]):
                continue
            here = Counter(stretch)
            score = sum(min(c, here[x]) for x, c in self.counts[n].items()) / size
            if score >= self.templates[n].share:
                out.append((n, max(0, begin), min(len(file), at + size), score))
                done = at + size
        return out


def _spans(folded: bytes, text_bytes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in code points."""
    inside = np.frombuffer(folded, np.uint8) != 32
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text_bytes, np.uint8) & 0xC0) != 0x80)])
    return points[np.flatnonzero(edges == 1)], points[np.flatnonzero(edges == -1)]


def document_frequency(docs: DataFrame, vocabulary: set[bytes], text_column: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many of all documents each word of a vocabulary of fixed size stands, and the number of documents."""

    def run(batches):
        seen, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                seen.update(vocabulary.intersection(words(text.as_py())))
        yield pa.record_batch([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), n], pa.int64())], ["word", "n"])

    rows = docs.select(text_or_empty(text_column)).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found, found.pop(b"", 0)


MATCHES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, settings: Settings = Settings(), text_column: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """docs, less the columns without, with n_words and matches: label, base, first_word, end_word (words from 0, the end
    exclusive), start, end (code points) and score of each, by place.

    A null or empty text has no words and no matches. Every row is scanned by itself, whole, whatever
    its id; an empty table gives none. Columns named n_words or matches are replaced.
    """
    vocabulary = {w for t in templates for w in words(t.text)}
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, *document_frequency(docs, vocabulary, text_column), settings))
    kept = docs.drop(*without, "n_words", "matches")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), text_or_empty(text_column).alias("_text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("_n", T.LongType()), T.StructField("_matches", MATCHES)])
    arrow = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scanned(text: str) -> tuple[int, list]:
        data = text.encode()
        folded = data.translate(FOLD)
        file = folded.split()
        found = index.value.matches(file)
        if not found:
            return len(file), []
        starts, ends = _spans(folded, data)
        of = index.value.templates
        return len(file), [(of[n].label, of[n].base, a, b, int(starts[a]), int(ends[b - 1]), score) for n, a, b, score in found]

    def run(batches):
        for batch in batches:
            start, size, out = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                out.append(scanned(text))
                size += len(text)
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    names = [f.name for f in arrow.value_type]
                    found = pa.array([[dict(zip(names, m)) for m in ms] for _, ms in out], arrow)
                    yield pa.record_batch([batch.column(0).slice(start, len(out)), pa.array([n for n, _ in out], pa.int64()), found], ["_row", "_n", "_matches"])
                    start, size, out = i + 1, 0, []

    return rows.mapInArrow(run, schema).select(*row_columns(kept), F.col("_n").alias("n_words"), F.col("_matches").alias("matches"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), without=("text",))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.withColumn("_base", base).select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda m: m["first_word"])).alias("last_word"),
        labels("_base").alias("base_labels"),
        labels("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
