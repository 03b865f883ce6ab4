"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document becomes pieces of at most ``capacity`` tokens. Full pieces are sequences
by themselves. The others are dealt by a hash to groups of about ``group_items``
and each group is packed by one task, longest pieces first: a piece goes to that
open sequence for which the sum of the squared counts of open sequences per
residual gap becomes smallest, and to a new one only if it fits no open one. The
state of a task is one count and one stack of sequences per gap.

A group of 32,000 pieces with evenly spread lengths leaves about 0.2 % of the
room unused; more groups, not larger ones, take up more documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quadrille.llm.common import beside, cut, row_columns, table, text_or_empty

CAPACITY = 1024
#: Rows of pieces in a record batch that a worker gives back.
BATCH_PIECES = 4096


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: printable
    Latin-1 characters for themselves, the others from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def tokenizer_of(content: bytes, pattern: str) -> Callable[[str], list[int]]:
    """The ids of a text by the byte-level BPE tokenizer that a JSON file of the tokenizers library describes.

    Its ids are the ranks of its merges, so the faster tiktoken library gives the same
    ids. The name of an added token in a text is that token, wherever it stands; what is
    between such names is encoded by itself.
    """
    described = json.loads(content)
    symbols, added = _byte_symbols(), {t["content"]: t["id"] for t in described["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in described["added_tokens"]):
        raise ValueError("added tokens that depend on what is around them are not supported")
    ranks = {bytes(symbols[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in added}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added:
        return plain
    names = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for m in names.finditer(text):
            ids += [*plain(text[at : m.start()]), added[m[0]]]
            at = m.end()
        return ids + plain(text[at:]) if at else plain(text)

    return encode


#: The tokenizers of this Python worker, by what they are made from.
_TOKENIZERS: dict[tuple[int, str], Callable[[str], list[int]]] = {}


def pieces(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of each row's text: _id, piece, start, length, ids_crc32 and, if wanted, ids.

    A text's ids are followed by end_id. More than capacity ids are cut so that all
    pieces but the first are full. ids are packed as little-endian unsigned 32-bit
    integers; null texts count as empty and are one piece of one id.
    """
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())  # of fixed size

    def run(batches):
        key = zlib.crc32(content.value), pattern
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = tokenizer_of(content.value, pattern)
        encode = _TOKENIZERS[key]
        names = ["_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[a:b].tobytes()
                    rows.append(i)
                    out.append((n, a, b - a, zlib.crc32(part), *[part] * with_ids))
                if len(out) >= BATCH_PIECES or i + 1 == batch.num_rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)
                    rows, out = [], []

    texts = df.select(F.col(id_column).alias("_id"), text_or_empty(text_column).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths are from 1 to capacity, in the order of placing."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences per gap; full ones don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        gaps, after = counts[size:], counts[: capacity + 1 - size]
        change = 2 * (after - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        change[gaps == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        gap = size + best
        if not counts[gap]:
            gap, stack, at = capacity, None, used
            used += 1
        else:
            counts[gap] -= 1
            at = stacks[gap].pop()
        sequence[k], offset[k] = at, capacity - gap
        if left := gap - size:
            counts[left] += 1
            stacks[left].append(at)
    return sequence, offset


def pack(parts: DataFrame, length_column: str = "length", capacity: int = CAPACITY, group_items: int = 1 << 15) -> DataFrame:
    """parts with sequence_id and offset, in place of columns of these names.

    Lengths are from 1 to capacity. Rows are dealt to groups by their place in the
    table, so equal rows don't meet in one group. An empty table gives an empty result.
    """
    numbered = cut(beside(parts, _length=F.col(length_column).cast("long"), _number=F.monotonically_increasing_id()))
    short = numbered.where(F.col("_length") < capacity)
    groups = max(1, -(-short.count() // group_items))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_length", "descending"), ("_number", "ascending")])
        sequence, offset = sum_of_squares(group.column("_length").to_numpy(), capacity)
        ids = sequence + (group.column("_group")[0].as_py() << 32)
        return group.select(["_row"]).append_column("_sequence", pa.array(ids)).append_column("_offset", pa.array(offset))

    schema = T.StructType([numbered.schema["_row"], T.StructField("_sequence", T.LongType()), T.StructField("_offset", T.LongType())])
    packed = short.withColumn("_group", F.pmod(F.xxhash64("_number"), F.lit(groups))).groupBy("_group").applyInArrow(run, schema)
    full = numbered.where(F.col("_length") == capacity).select("_row", (-1 - F.col("_number")).alias("_sequence"), F.lit(0).cast("long").alias("_offset"))
    return packed.unionByName(full).select(*row_columns(parts, ("sequence_id", "offset")), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 2, group_items: int = 1 << 15) -> DataFrame:
    """Where each piece of each document goes; rows of null id and repeated ids are documents of their own."""
    found = pieces(df, id_column, text_column, vocabulary, end_id=end_id, capacity=capacity, with_ids=False)
    return pack(found, capacity=capacity, group_items=group_items).withColumnRenamed("_id", id_column)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
