"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one last token is right: the one that ends the
encoding of that prefix. A token that ends at a prefix is right if what stands
before it is empty, or if it may follow the last token of the shorter prefix. So
a piece is encoded left to right, one last token for each byte, and read off from
the end. The stored tokens allow exact appends, and after an edit only the
prefixes from there on until as many last tokens as the longest token has bytes
agree with the old ones again.

Two tokens may stand side by side if no merge across their border would have come
before the merges that made them (see ``Vocabulary.may_follow``).
"""

from __future__ import annotations

import base64
import hashlib
import struct

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quadrille.llm.common import row_columns, table, text_or_empty

#: Pieces kept with their ids by each Python worker, in two generations: when the
#: young one has as many, it becomes the old one, and what is used again moves up.
CACHED_PIECES = 150_000
#: Longer pieces are not kept.
CACHED_LENGTH = 48
#: Bytes of text in a record batch that a worker gives back.
BATCH_BYTES = 4 << 20


class Vocabulary:
    """Tokens by rank; a merge of two tokens has the rank of the token it makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._last_merge(token, rank)):
                self.parts[rank] = pair
                self.merges[pair] = rank
        self.rights = [self._spine(t, 1) for t in range(len(self.tokens))]
        self.lefts = [self._spine(t, 0) for t in range(len(self.tokens))]
        #: Answers of may_follow so far.
        self.followers: dict[tuple[int, int], bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that token is merged from: those left when only lower merges are done."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: r if (r := self.ranks.get(parts[i] + parts[i + 1], rank)) < rank else rank)
            if self.ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """token, its part at that side, that one's part and so on, each with the rank of what it is merged into."""
        out, until = [], len(self.tokens)
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = token, self.parts[token][side]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens.

        At any time one part of first's right side and one of second's left side meet at
        the border. A merge of the two comes about if it precedes those that merge each of
        them within its own token; of equal merges the left one is done first.
        """
        get = self.merges.get
        right = not any((m := get((a, b))) is not None and m < until_a and m <= until_b for a, until_a in self.rights[first] for b, until_b in self.lefts[second])
        if len(self.followers) > 2 * CACHED_PIECES:
            self.followers.clear()
        self.followers[first, second] = right
        return right


class PrefixTable:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def _fill(self, until: int) -> None:
        """Last tokens for all prefixes of up to until bytes. Only one token is right, so short ones, the likelier, are tried first."""
        data, last, v = self.data, self.last, self.vocabulary
        get, known, may_follow = v.ranks.get, v.followers.get, v.may_follow
        for end in range(len(last) + 1, until + 1):
            for start in range(end - 1, max(-1, end - v.longest - 1), -1):
                token = get(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                right = known((last[start - 1], token))
                if right or right is None and may_follow(last[start - 1], token):
                    break
            else:
                raise ValueError("the vocabulary has no token for one of the bytes")
            last.append(token)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put new in place of data[start:end]; returns how many prefixes were encoded again."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        agree = 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            if agree >= self.vocabulary.longest:  # all that later prefixes look back to is as it was
                self.last += old[at - shift :]
                return at - start
            self._fill(at + 1)
            agree = agree + 1 if at >= start + len(new) and self.last[at] == old[at - shift] else 0
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(token := self.last[end - 1])
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Encoder:
    """Texts to ids: each match of pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pieces_of = Vocabulary(ranks), regex.compile(pattern).findall
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _pack(self, piece: str) -> bytes:
        packed = self._old.get(piece)
        if packed is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).ids()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_LENGTH:
            self._young[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if len(self._young) > CACHED_PIECES:
            self._young, self._old = {}, self._young
        get, pack = self._young.get, self._pack
        return b"".join([get(piece) or pack(piece) for piece in self.pieces_of(text)])


class Decoder:
    """Packed ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


#: What this Python worker has made so far, by kind and by what it is made from.
_MADE: dict[tuple, Encoder | Decoder] = {}


def _made(kind: type, content: bytes, *more) -> Encoder | Decoder:
    key = kind.__name__, hashlib.sha256(content).digest(), *more
    if key not in _MADE:
        _MADE[key] = kind(read_ranks(content), *more)
    return _MADE[key]


def _mapped(df: DataFrame, value: Column, to: str, without: tuple[str, ...], vocabulary: str | None, pattern: str | None) -> DataFrame:
    """df without some columns, with the binary column to: value encoded (by a pattern) or decoded
    (without one). The vocabulary file, of fixed size, is broadcast."""
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        make = _made(Encoder, content.value, pattern).encode if pattern else _made(Decoder, content.value).decode
        for batch in batches:
            start, size, out = 0, 0, []
            for i, given in enumerate(batch.column(1)):
                given = given.as_py()
                out.append(make(given))
                size += len(given)
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.record_batch([batch.column(0).slice(start, len(out)), pa.array(out, pa.binary())], ["_row", "_made"])
                    start, size, out = i + 1, 0, []

    kept = df.drop(*without, to)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), value.alias("_value"))
    made = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_made", T.BinaryType())]))
    return made.select(*row_columns(kept), F.col("_made").alias(to))


def encode(df: DataFrame, text_column: str = "text", ids_column: str = "ids", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the text column replaced by its ids, packed as little-endian unsigned 32-bit integers.

    A null text counts as empty; an empty text has no ids. Special tokens' names in a
    text are ordinary text. Other columns are kept as they are.
    """
    return _mapped(df, text_or_empty(text_column), ids_column, (text_column,), vocabulary, pattern)


def decode(df: DataFrame, ids_column: str = "ids", bytes_column: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with the bytes that its packed ids stand for; the ids are kept. Null ids count as none."""
    return _mapped(df, F.coalesce(F.col(ids_column), F.lit(b"")), bytes_column, (), vocabulary, None)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
