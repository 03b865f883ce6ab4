"""SimHash near-dedup with pivot distance tables.

Fingerprints have 64 bits. Their table holds the Hamming distances to reference
fingerprints: zero, and a mask for each pair of neighbouring bits. By the triangle
inequality, two fingerprints within r differ by at most r in every coordinate, so
a pair with a larger coordinate difference is discarded unseen; survivors are
verified by their Hamming distance.

So that not every pair must be looked at, the coordinates also make keys. The
distance to a mask less that to zero tells how many of the mask's bits are set,
and two fingerprints within r differ in r masks at most. With the masks dealt to
r + k bands, k whole bands agree: the coordinates of each choice of k bands are
a key, and only fingerprints with a key in common are compared. No pair within r
is lost. Many more bands than r make keys more selective, at more keys a row.

Equal fingerprints are one node. A key that more than ``most`` fingerprints share
(clusters of near copies) is not expanded into pairs: its fingerprints go on to a step
with more and narrower bands, whose keys hold more of the coordinates. In the last
step only r pairs of bits are left out of a key, and references for single bits tell
all fingerprints apart, so that at most 4^r can share one. A pair within r shares a
key in every step; it is found in the first one where such a key is not crowded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.llm.common import beside, cut, fresh_path, looked_up, release, row_columns, table, text_or_empty, written
from quadrille.llm.components import components, joined

BITS = 64
#: Shingles hashed at a time, so that a very long text takes bounded memory.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, in chunks: A-Z in lower case, words joined by a space."""
    found = text.lower().split()
    if not found:
        return
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, len(found) - words + 1, CHUNK):
        part = found[at : at + CHUNK + words - 1]
        yield np.fromiter((digest(join(x), seed) for x in zip(*(part[i:] for i in range(words)))), np.uint64)


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """The text's fingerprint as a signed 64-bit integer; zero for a text without words."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0]) if total else 0


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """(_id, _fp) for each row of df; a null text counts as empty and has fingerprint 0."""

    def compute(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(x.as_py(), words) for x in batch.column(1)], pa.int64())], ["_id", "_fp"])

    rows = df.select(F.col(id_column).alias("_id"), text_or_empty(text_column).cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(compute, f"_id {kind}, _fp bigint")


#: Pairs of neighbouring bits, each with a mask among the references.
PAIRS = BITS // 2
#: Bands that the pairs are dealt to, step by step; in the last step each pair is a band.
BANDS = (6, 12, PAIRS)


def references(fine: bool = False) -> np.ndarray:
    """Zero and a mask for each pair of neighbouring bits; if fine, also one for the first bit of
    each, so that the distances tell all fingerprints apart."""
    masks = [0b11 << i for i in range(0, BITS, 2)] + [1 << i for i in range(0, BITS, 2)] * fine
    return np.array([0, *masks], np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """A row for each fingerprint: its Hamming distances to the references."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :])


def _mixed(parts: np.ndarray, start: int) -> np.ndarray:
    """A 64-bit key for each row of small numbers (FNV-1a over its entries)."""
    key = np.full(len(parts), 14695981039346656037 ^ start, np.uint64)
    for column in parts.T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(1099511628211)
    return key ^ (key >> np.uint64(32))


def keys(distances: np.ndarray, radius: int, bands: int) -> Iterator[np.ndarray]:
    """A key of each row for each choice of bands - radius bands, from the distances to their pairs' masks."""
    relative = distances[:, 1:] - distances[:, :1]  # modulo 256, which keeps them apart
    inside = [np.concatenate([x + at for at in range(0, relative.shape[1], PAIRS)]) for x in np.array_split(np.arange(PAIRS), bands)]
    for k, chosen in enumerate(combinations(inside, bands - radius)):
        yield _mixed(relative[:, np.concatenate(chosen)], k)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _table_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width).astype(np.int16)


def _near_in_keys(active: DataFrame, radius: int, bands: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Fingerprints of active (_fp) by the keys that two or more share, with how many do (_key, _fp, _n);
    and what makes the pairs (u, v) within radius of such rows."""
    refs = references(fine=bands == PAIRS)

    def keyed_rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096)
                for key in keys(distance_table(_numbers(fps), refs), radius, bands):
                    yield pa.record_batch([pa.array(key.view(np.int64)), fps], ["_key", "_fp"])

    def with_table(batches):
        for batch in batches:
            rows = distance_table(_numbers(batch.column(1)), refs)
            yield pa.record_batch([*batch.columns, pa.array([x.tobytes() for x in rows], pa.binary())], ["_key", "_fp", "_d"])

    def verify(batches):
        for batch in batches:
            du, dv = (_table_of(batch.column(i), len(refs)) for i in (2, 3))
            near = np.abs(du - dv).max(1, initial=0) <= radius
            near &= np.bitwise_count(_numbers(batch.column(0)) ^ _numbers(batch.column(1))) <= radius
            yield pa.record_batch(batch.columns[:2], ["u", "v"]).filter(pa.array(near))

    def verified(rows: DataFrame) -> DataFrame:
        tables = rows.select("_key", "_fp").mapInArrow(with_table, "_key bigint, _fp bigint, _d binary")
        left, right = (tables.select("_key", F.col("_fp").alias(x), F.col("_d").alias(f"_d{x}")) for x in "uv")
        pairs = left.join(right, "_key").where("u < v").select("u", "v", "_du", "_dv")
        return pairs.mapInArrow(verify, "u bigint, v bigint")

    keyed = cut(active.select("_fp").mapInArrow(keyed_rows, "_key bigint, _fp bigint"))
    shared = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return cut(keyed.join(shared, "_key")), verified


def links(distinct: DataFrame, radius: int = 2, bands: tuple[int, ...] = BANDS, most: int = 32) -> DataFrame:
    """(u, v), u < v, for all pairs of fingerprints of distinct (_fp) within radius."""
    if not 0 <= radius < bands[0] or bands[-1] != PAIRS:
        raise ValueError(f"the radius must be less than the first number of bands, and the last one {PAIRS}")
    active, found = distinct, None
    for many in bands:
        members, verified = _near_in_keys(active, radius, many)
        open_ones = cut(members.where(F.col("_n") > most).select("_fp").distinct()) if many < PAIRS else None
        pairs = verified(members if open_ones is None else members.where(F.col("_n") <= most))
        found = pairs if found is None else found.unionByName(pairs)
        if open_ones is None or not open_ones.take(1):
            break
        active = open_ones
    return found.distinct()


def groups(prints: DataFrame, radius: int = 2, bands: tuple[int, ...] = BANDS, most: int = 32, runs: int = 64) -> DataFrame:
    """component_id for each row (_id, _fp) of prints: the smallest id that links reach.

    prints must give the same rows whenever it is read. Null ids take part; they count
    as larger than any other, so component_id is null only if all ids of a group are.
    """
    dealt = prints.withColumn("_run", F.pmod(F.xxhash64("_id"), F.lit(runs)))
    in_runs = cut(dealt.groupBy("_run", "_fp").agg(F.min("_id").alias("_least")))
    distinct = cut(in_runs.groupBy("_fp").agg(F.min("_least").alias("_least")))
    roots = cut(components(links(distinct.select("_fp"), radius, bands, most)))
    linked = distinct.join(roots, distinct["_fp"] == roots["node"]).select("_fp", "root", "_least")
    least = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_linked = looked_up(roots, least, "root", "node").select(F.col("node").alias("_fp"), "component_id")
    of_all = distinct.join(of_linked, "_fp", "left").select("_fp", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("_least")).alias("component_id"))
    # By way of the runs, so that a fingerprint that many rows share meets in many tasks.
    return dealt.join(in_runs.select("_run", "_fp").join(of_all, "_fp"), ["_run", "_fp"]).select("_id", "_fp", "component_id")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 2, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """id, _fp and component_id for each row of df.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Rows
    that repeat an id are rows of their own. An empty table gives an empty result.
    """
    found = groups(cut(fingerprints(df, id_column, text_column, words)), radius, bands)
    return found.select(F.col("_id").alias(id_column), F.col("_fp").alias("fingerprint"), "component_id")


#: Odd multipliers, one for each place in a shingle.
PLACES = [((0x9E3779B97F4A7C15 * (2 * k + 1)) ^ (k << 17)) % (1 << 64) | 1 for k in range(64)]
#: The one shingle of a text without words.
NO_WORDS = np.array([1], np.uint64)
#: Shingle hashes of a task that are sorted and dealt out together.
DEAL = 1 << 21
#: So many of the most frequent shingles at most are known to be frequent. It bears on speed alone.
FREQUENT = 1 << 20
#: Bits of a text's marks, a power of two.
MARKS = 2048
#: Rounds in which nearest texts in crowded keys are linked before all other pairs are looked for. It bears on speed alone.
ROUNDS = 2
#: Bits of the filter by which texts are chosen whose sets are compared, a power of two.
SIEVE = 1 << 26


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes, made of the hashes of their words."""
    found = text.lower().split()
    if not found:
        return NO_WORDS
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), words)], np.uint64)
    each, count = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)), len(found) - words + 1
    x = np.zeros(count, np.uint64)
    for k in range(words):
        x += each[k : k + count] * np.uint64(PLACES[k])
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ (x >> np.uint64(29)))


def least_common(size, similarity: float):
    """How many of its shingles a set of this size shares at least with a similar one."""
    return np.ceil(similarity * size - 1e-6).astype(np.int64)


def least_in_prefixes(a, b, similarity: float):
    """How many shingles the prefixes of similar sets of sizes a and b have in common at least."""
    both = np.ceil(similarity / (1 + similarity) * (a + b) - 1e-6).astype(np.int64)
    return np.maximum(both - np.maximum(least_common(a, similarity), least_common(b, similarity)) + 1, 1)


def _dealt(rows: np.ndarray, high: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Rows as one binary value for each range of the 32-bit numbers high."""
    part = (high.astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return pa.record_batch([pa.array(part[starts].astype(np.int64)), pa.array([x.tobytes() for x in np.split(rows, starts[1:])], pa.binary())], ["_range", "_rows"])


def frequent_shingles(texts: DataFrame, words: int, ranges: int, share: int = 4, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The first 32 bits of the hashes of the FREQUENT most frequent shingles of texts (_n, _text), in order, and how
    often they occur, in one of share texts."""

    def deal(batches):
        held, total = [], 0
        for batch in batches:
            for text in batch.column(1):
                held.append((shingle_set(text.as_py(), words) >> np.uint64(32)).astype(np.uint32))
                total += len(held[-1])
                if total >= DEAL:
                    rows = np.concatenate(held)
                    yield _dealt(rows, rows, ranges)
                    held, total = [], 0
        if held:
            rows = np.concatenate(held)
            yield _dealt(rows, rows, ranges)

    def count(batches):
        held = [np.frombuffer(x.as_py(), np.uint32) for batch in batches for x in batch.column(1)]
        if held:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= least
            yield pa.record_batch([pa.array(found[many].astype(np.int64)), pa.array(times[many].astype(np.int64))], ["_hash", "_times"])

    some = texts.where(F.pmod("_n", F.lit(share)) == 0)
    dealt = some.select("_n", "_text").mapInArrow(deal, "_range bigint, _rows binary").repartition(ranges, "_range")
    counted = cut(dealt.mapInArrow(count, "_hash bigint, _times bigint"))
    power, held = F.floor(F.log2("_times")), 0
    lowest = 64
    for row in sorted(counted.groupBy(power.alias("p")).count().collect(), reverse=True):
        held += row["count"]
        if held > FREQUENT:
            break
        lowest = row["p"]
    found = counted.where(power >= lowest).toArrow()
    hashes, times = found.column(0).to_numpy().astype(np.uint32), found.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def prefix_entries(texts: DataFrame, words: int, similarity: float, ranges: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(_key, _n, _size, _crowded) for each shingle in the prefix of a text of texts (_n, _text) that is in that of another, too;
    and (_n, _size, _marks) for each text.

    A prefix holds the rarest shingles of a set, as many as it may lack of a similar one and one more,
    so that similar sets have a shingle of their prefixes in common. Shingles are in order of frequency,
    then of their hashes. A key is crowded if more than ``most`` texts have it. Marks are MARKS bits that
    each tell whether the number of shingles that fall on it is odd.
    """
    frequent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, words, ranges))
    kind = np.dtype([("key", np.uint64), ("n", np.int64), ("size", np.int32)])
    marked = np.dtype([("n", np.int64), ("size", np.int32), ("marks", f"V{MARKS // 8}")])

    def dealt_out(held: list[np.ndarray], of_texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        yield _dealt(rows, rows["key"] >> np.uint64(32), ranges)
        marks = np.array(of_texts, marked)
        # Ranges from -1 down hold marks.
        part = _dealt(marks, marks["n"].view(np.uint64) >> np.uint64(32), ranges)
        yield pa.record_batch([pc.subtract(-1, part.column(0)), part.column(1)], ["_range", "_rows"])

    def deal(batches):
        hashes, times = frequent.value
        held, of_texts, total = [], [], 0
        for batch in batches:
            for n, text in zip(batch.column(0).to_numpy(), batch.column(1)):
                found = shingle_set(text.as_py(), words)
                taken = len(found) - int(least_common(len(found), similarity)) + 1
                if len(hashes):
                    high = (found >> np.uint64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(hashes, high), len(hashes) - 1)
                    often = np.where(hashes[at] == high, times[at], 0)
                    chosen = found[np.argsort(often, kind="stable")[:taken]]
                else:
                    chosen = found[:taken]
                rows = np.empty(taken, kind)
                rows["key"], rows["n"], rows["size"] = chosen, n, len(found)
                held.append(rows)
                odd = np.bincount((found & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
                of_texts.append((n, len(found), np.packbits(odd).tobytes()))
                total += taken
                if total >= DEAL:
                    yield from dealt_out(held, of_texts)
                    held, of_texts, total = [], [], 0
        if held:
            yield from dealt_out(held, of_texts)

    def shared(batches):
        held = []
        for batch in batches:
            for number, blob in zip(batch.column(0), batch.column(1)):
                if number.as_py() >= 0:
                    held.append(np.frombuffer(blob.as_py(), kind))
                    continue
                rows = np.frombuffer(blob.as_py(), marked)
                none = pa.nulls(len(rows), pa.int64())
                columns = [none, pa.array(rows["n"].copy()), pa.array(rows["size"].copy()), pa.nulls(len(rows), pa.bool_()), pa.array([x.tobytes() for x in rows["marks"]], pa.binary())]
                yield from pa.Table.from_arrays(columns, ["_key", "_n", "_size", "_crowded", "_marks"]).to_batches(4096)
        if not held:
            return
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["n"], rows["key"]))]
        same = rows["key"][1:] == rows["key"][:-1]
        # The same row twice is one.
        rows = rows[np.concatenate([[True], ~(same & (rows["n"][1:] == rows["n"][:-1]))])]
        starts = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        sizes = np.diff(np.append(starts, len(rows)))
        of_key = np.repeat(sizes, sizes)
        rows, of_key = rows[of_key > 1], of_key[of_key > 1]
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            columns = [pa.array(part["key"].copy().view(np.int64)), pa.array(part["n"].copy()), pa.array(part["size"].copy()), pa.array(of_key[at : at + (1 << 16)] > most), pa.nulls(len(part), pa.binary())]
            yield pa.record_batch(columns, ["_key", "_n", "_size", "_crowded", "_marks"])

    dealt = texts.select("_n", "_text").mapInArrow(deal, "_range bigint, _rows binary").repartition(ranges, "_range")
    both = cut(dealt.mapInArrow(shared, "_key bigint, _n bigint, _size int, _crowded boolean, _marks binary"))
    return both.where("_marks IS NULL").drop("_marks"), both.where("_marks IS NOT NULL").select("_n", "_size", "_marks")


def _whole_groups(batches) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by the first one, in parts that end where its values change."""
    held: list[np.ndarray] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = [np.concatenate(x) for x in zip(held, columns)] if held else columns
        if not len(columns[0]):
            continue
        before = np.flatnonzero(columns[0] != columns[0][-1])
        end = before[-1] + 1 if len(before) else 0
        if end:
            yield [c[:end] for c in columns]
        held = [c[end:] for c in columns]
    if held and len(held[0]):
        yield held


def _groups_of(batches) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal values in the first column, of batches that are sorted by it."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        ends = np.append(np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1, len(columns[0]))
        at = 0
        for end in ends:
            if held and held[0][0][0] != columns[0][at]:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            held.append([c[at:end] for c in columns])
            at = end
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _batch_of_pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def with_roots(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """entries with the _root that their texts have by now."""
    if roots is None:
        return entries.withColumn("_root", F.col("_n"))
    found = roots.select(F.col("node").alias("_n"), F.col("root").alias("_found"))
    return entries.join(found, "_n", "left").select(*entries.columns, F.coalesce("_found", "_n").alias("_root"))


def neighbour_pairs(entries: DataFrame, roots: DataFrame | None, similarity: float) -> DataFrame:
    """(u, v, shared, need): for each text of entries those of another root that stand before it, or first, in a key of
    its own; in how many keys they do, and how many keys they share if they are similar. Two a key and text at most."""

    def neighbours(batches):
        key, leader, last = None, (0, 0, 0), (0, 0, 0)  # the run that the rows before this batch ended in
        for batch in batches:
            b, *columns = (batch.column(i).to_numpy() for i in range(4))
            if not len(b):
                continue
            n, size, root = columns
            same = np.concatenate([[key is not None and b[0] == key], b[1:] == b[:-1]])
            starts = np.maximum.accumulate(np.where(same, -1, np.arange(len(b))))
            heads = [np.where(starts >= 0, x[np.maximum(starts, 0)], was) for x, was in zip(columns, leader)]
            before = [np.concatenate([[was], x[:-1]]) for x, was in zip(columns, last)]
            key, leader, last = b[-1], tuple(x[-1] for x in heads), tuple(x[-1] for x in columns)
            for other, other_size, other_root in (heads, before):
                wanted = same & (root != other_root)
                if other is not heads[0]:
                    wanted &= other != heads[0]
                need = least_in_prefixes(size[wanted], other_size[wanted], similarity)
                yield pa.record_batch([pa.array(n[wanted]), pa.array(other[wanted]), pa.array(need)], ["u", "v", "need"])

    rows = with_roots(entries.select("_key", "_n", "_size"), roots).repartition("_key").sortWithinPartitions("_key", "_root", "_n")
    near = rows.mapInArrow(neighbours, "u bigint, v bigint, need bigint")
    return near.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need")).where("u <> v")


def likely_links(pairs: DataFrame) -> DataFrame:
    """(u, v): of the neighbour pairs of each text that share many keys the one that shares most."""
    best = pairs.where("2 * shared >= need").groupBy("u").agg(F.max_by("v", F.struct("shared", -F.col("v"))).alias("v"))
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def closest(pairs: DataFrame) -> DataFrame:
    """(u, v): of the possible pairs of each text the closest one."""
    return cut(pairs.groupBy("u").agg(F.min_by("v", F.struct("_apart", "v")).alias("v")))


def _may_be_similar(a, b, marks_a: np.ndarray, marks_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether marks leave it open that sets of sizes a and b are similar: a mark that differs stands for a shingle
    at least that only one of them has."""
    apart = np.bitwise_count(marks_a ^ marks_b).sum(-1, dtype=np.int64)
    both = np.add(a, b, dtype=np.float64)
    return (both - apart) / 2 >= similarity / (1 + similarity) * both - 1e-6


def _rooted(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """entries with the _root that their texts have by now and how many crowded keys these have (_crowds), without
    the keys whose rows all have one root: they have nothing to add."""
    crowd = entries.where("_crowded").groupBy("_n").agg(F.count(F.lit(1)).alias("_crowds"))
    rows = with_roots(entries, roots).join(crowd, "_n", "left")
    rows = rows.select("_key", "_n", "_size", "_crowded", F.coalesce("_crowds", F.lit(0)).cast("int").alias("_crowds"), "_root")
    mixed = rows.groupBy("_key").agg((F.min("_root") < F.max("_root")).alias("_mixed")).where("_mixed").select("_key")
    return cut(rows.join(mixed, "_key"))


def _by_key(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("_key", "_n", "_size", "_crowds", "_root", *more).repartition("_key").sortWithinPartitions("_key")


def crowded_pairs(rows: DataFrame, marks: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """(u, v, _apart) for rows in crowded keys that have enough of them in common with one of another root, and whose marks
    leave it open that they are similar; _apart is the share of their shingles that is not common at least.

    Roots with more rows in a key come first: rows are compared with those of the roots before theirs, with all of
    them, or to give the nearest one alone.
    """

    def many(batches):
        for _, n, size, crowds, root, odd in _groups_of(batches):
            _, which, rows_of = np.unique(root, return_inverse=True, return_counts=True)
            rank = np.argsort(np.argsort(-rows_of, kind="stable"), kind="stable")[which]
            order = np.argsort(size, kind="stable")
            n, size, crowds, rank = n[order], size[order], crowds[order], rank[order]
            bits = np.frombuffer(b"".join(odd[order]), np.uint64).reshape(-1, MARKS // 64)
            for at in np.flatnonzero(rank > 0):
                low, high = np.searchsorted(size, [least_common(size[at], similarity), size[at] / similarity + 1])
                fits = (rank[low:high] < rank[at]) & (least_in_prefixes(size[at], size[low:high], similarity) <= np.minimum(crowds[at], crowds[low:high]))
                other = low + np.flatnonzero(fits)
                other = other[_may_be_similar(size[at], size[other], bits[at], bits[other], similarity)]
                if not len(other):
                    continue
                apart = np.bitwise_count(bits[at] ^ bits[other]).sum(-1, dtype=np.int64) / np.add(size[at], size[other], dtype=np.float64)
                if nearest:
                    best = np.lexsort((n[other], apart))[:1]
                    other, apart = other[best], apart[best]
                yield pa.record_batch([pa.array(np.full(len(other), n[at])), pa.array(n[other]), pa.array(apart)], ["u", "v", "_apart"])

    marked = rows.where("_crowded").join(marks.select("_n", "_marks"), "_n")
    return _by_key(marked, "_marks").mapInArrow(many, "u bigint, v bigint, _apart double")


def open_pairs(entries: DataFrame, marks: DataFrame, roots: DataFrame | None, similarity: float) -> DataFrame:
    """(u, v) for all rows of entries that may be similar and have different roots.

    Pairs come from every key they share. One that shares only crowded keys is made where it has enough
    of them and their marks allow it; others count the keys that are not crowded, to which the crowded ones
    of the row with fewer of them are added. All are upper bounds of what the texts have in common, so no
    similar pair is lost.
    """
    rows = _rooted(entries, roots)

    def few(batches):
        for key, n, size, crowds, root in _whole_groups(batches):
            apart = 1
            while apart < len(key) and len(i := np.flatnonzero(key[apart:] == key[:-apart])):
                j = i + apart
                fits = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= least_common(np.maximum(size[i], size[j]), similarity))
                i, j = i[fits], j[fits]
                need = least_in_prefixes(size[i], size[j], similarity) - np.minimum(crowds[i], crowds[j])
                yield pa.record_batch([*_batch_of_pairs(n[i], n[j]).columns, pa.array(need)], ["u", "v", "need"])
                apart += 1

    counted = _by_key(rows.where("NOT _crowded")).mapInArrow(few, "u bigint, v bigint, need bigint").groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need"))
    crowded = crowded_pairs(rows, marks, similarity, nearest=False).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return counted.where("shared >= need").select("u", "v").unionByName(crowded).distinct()


def with_both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (u, v), a table or checkpoint, with the columns of values (_n and others) for both, named _..._u and _..._v.

    The pairs of a node that has many are dealt to parts, and each part gets the node's values once.
    """
    out = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(64)).alias("_part_u"), F.pmod(F.xxhash64("u"), F.lit(64)).alias("_part_v"))
    nodes = out
    for x in "uv":
        of = values.select(F.col("_n").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in values.columns if c != "_n"])
        out = out.join(nodes.select(x, f"_part_{x}").distinct().join(of, x), [x, f"_part_{x}"])
    return out.drop("_part_u", "_part_v")


def possible_pairs(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """(u, v, _apart) for the pairs (u, v) whose marks leave it open that they are similar, and what share of their
    shingles is not common at least.
    """

    def judge(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (2, 3))
            mu, mv = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, MARKS // 64) for i in (4, 5))
            apart = np.bitwise_count(mu ^ mv).sum(1, dtype=np.int64) / np.add(a, b, dtype=np.float64)
            yield pa.record_batch([*batch.columns[:2], pa.array(apart)], ["u", "v", "_apart"]).filter(pa.array(_may_be_similar(a, b, mu, mv, similarity)))

    both = with_both(cut(pairs.select("u", "v")), marks)
    return cut(both.select("u", "v", "_size_u", "_size_v", "_marks_u", "_marks_v").mapInArrow(judge, "u bigint, v bigint, _apart double"))


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have the similarity, for texts (_n, _text). pairs is a table or checkpoint.

    Sets are made where the texts are read, of those that a filter of SIEVE bits lets pass: all that are in
    pairs, and a few others. So texts are not shuffled, and what is broadcast is of a fixed size.
    """
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("_n"))
    place = nodes.select(F.pmod("_n", F.lit(SIEVE)).alias("_at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_at", F.lit(64)).cast("int"))
    bits = place.groupBy(F.floor(F.col("_at") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits")).toArrow()  # SIEVE / 64 rows at most
    sieve = np.zeros(SIEVE // 64, np.int64)
    sieve[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(sieve)

    def compute(batches):
        for batch in batches:
            at = batch.column(0).to_numpy() % SIEVE
            for part in batch.filter(pa.array(sent.value[at >> 6] >> (at & 63) & 1 == 1)).to_struct_array().to_pylist() if batch.num_rows else []:
                yield pa.record_batch([pa.array([part["_n"]]), pa.array([shingle_set(part["_text"], words).tobytes()], pa.binary())], ["_n", "_set"])

    def verify(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.record_batch(batch.columns[:2], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    read = texts.select("_n", "_text").mapInArrow(compute, "_n bigint, _set binary")
    sets = cut(read.groupBy("_n").agg(F.first("_set").alias("_set")))
    return cut(with_both(pairs, sets).select("u", "v", "_set_u", "_set_v").mapInArrow(verify, "u bigint, v bigint"))


def still_open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose nodes are not joined yet."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"_root_{x}"))
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.where(F.coalesce("_root_u", "u") != F.coalesce("_root_v", "v")).select(*pairs.columns)


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """(u, v) for rows (_n, _text): each text v that fingerprints join with others, and u, the first text of its group."""
    found = near_duplicates(rows, "_n", "_text")
    return cut(found.where("component_id < _n").select(F.col("component_id").alias("u"), F.col("_n").alias("v")).distinct())


def similarity_groups(texts: DataFrame, near: DataFrame, words: int = 5, similarity: float = 0.8, most: int = 32) -> DataFrame:
    """(node, root) for the texts (_n, _text) that chains of similar pairs join with others; root is the smallest _n.

    The pairs (u, v) of near, a table or checkpoint, are those that SimHash finds; they are looked at first. The search
    for similar ones among all others is exact: likely pairs, and each text's closest neighbour in crowded keys,
    in ROUNDS rounds; then all pairs that prefixes and marks allow and that these do not join yet, of each
    text the closest one before the others. Every link is checked by its shingle sets.
    """
    spark = texts.sparkSession

    def compare(pairs: DataFrame) -> DataFrame:
        found = similar_pairs(pairs, texts, words, similarity)
        release(spark)
        return found

    roots = cut(components(compare(near)))
    entries, marks = prefix_entries(texts, words, similarity, max(16, texts.rdd.getNumPartitions()), most)
    release(spark)
    marks = marks.dropDuplicates(["_n"])
    possible = lambda pairs: possible_pairs(pairs, marks, similarity)
    roots = joined(roots, compare(possible(likely_links(neighbour_pairs(entries, roots, similarity)))))
    # Crowded keys are where pairs grow with the square of a group: each text's nearest one of another root goes first.
    crowded = cut(entries.where("_crowded"))
    for _ in range(ROUNDS if crowded.take(1) else 0):
        more = compare(closest(crowded_pairs(_rooted(crowded, roots), marks, similarity, nearest=True)))
        if not more.take(1):
            break
        roots = joined(roots, more)
    left = possible(open_pairs(entries, marks, roots, similarity))
    first = closest(left)
    roots = joined(roots, compare(first))
    left = cut(still_open(left.select("u", "v").join(first, ["u", "v"], "left_anti"), roots))
    return joined(roots, compare(left)) if left.take(1) else roots


def told_apart(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """rows with a number _n made of two 64-bit hashes: rows have the same number if both hashes are the same.

    It is the first hash, but for rows that share it with one of a smaller second hash: they get a hash of both. Such
    clashes are few, if there are any, and are looked for before: one aggregation of the hashes alone.
    """
    seen = rows.select(first.alias("_first"), second.alias("_second"))
    of_first = seen.groupBy("_first").agg(F.min("_second").alias("_least"), F.max("_second").alias("_most"))
    clashes = written(of_first.where("_least < _most").select("_first", "_least"), fresh_path(rows.sparkSession, "clashes"))
    if not clashes.take(1):
        return rows.withColumn("_n", first)
    found = rows.withColumns({"_first": first, "_second": second}).join(clashes, "_first", "left")
    number = F.when(F.col("_second") > F.col("_least"), F.xxhash64("_first", "_second")).otherwise(F.col("_first"))
    return found.withColumn("_n", number).drop("_first", "_second", "_least")


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df that stay: of each group of similar texts the row with the smallest id, a null id
    counting as larger than any other.

    Groups of near_duplicates come first, by fingerprints and pivot tables; their texts are checked against the first one of
    their group. Pairs beyond the radius of fingerprints are found by an exact search. Texts are similar if the Jaccard similarity of their sets of shingles of words words is similarity or
    more; all such pairs are found. Null, empty and blank texts are similar to each other. Rows that repeat
    id and text all stay if one does: texts are told apart here, not rows. An empty table stays empty.
    """
    spark, none = df.sparkSession, F.col("_id").isNull()
    rows = beside(df, _id=F.col(id_column), _text=text_or_empty(text_column))
    rows = told_apart(rows, F.xxhash64(none, "_id", "_text"), F.xxhash64("_text", none, "_id"))
    key = F.struct(none.alias("none"), F.col("_id").alias("id"), F.xxhash64("_text").alias("hash"))
    release(spark)
    near = simhash_pairs(rows.select("_n", "_text"))
    release(spark)
    roots = similarity_groups(rows.select("_n", F.col("_text").cast("binary").alias("_text")), near, words, similarity)
    keys = rows.select(F.col("_n").alias("node"), key.alias("_key"))
    grouped = cut(keys.join(roots, "node").groupBy("node", "root").agg(F.first("_key").alias("_key")))
    stay = grouped.groupBy("root").agg(F.min_by("node", "_key").alias("node"))
    # A table, so that its size is known: if it is small, texts need not be shuffled to be looked up in it.
    gone = written(grouped.select("node").join(stay, "node", "left_anti"), fresh_path(spark, "gone"))
    return rows.join(gone, F.col("_n") == gone["node"], "left_anti").select(*row_columns(df))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
