"""The trie of conversations against a plain one made of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.llm import prefix_trie as M

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(df, block=M.BLOCK):
    nodes, ends = M.prefix_trie(*M.rebuilt(M.ordered_turns(df)), block)
    out = nodes.join(M.ends_digests(ends), M.KEY, "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"] or empty) for r in out)


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(98, 130), *range(700, 760), -3, -100, -104, 10**12]:
        n = rng.choice([1, 1, 2, 3, 5, 9, 14])
        for turn in range(n):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b🙂", "", None, "a long text that some share"])))
    rows += rows[:5] + [(None, 1, "user", "of no conversation"), (700, 3, "user", "same turn"), (700, 3, "user", "same turn, too")]
    rows += [(5, t, "user", "ab"[t % 2]) for t in range(300)] + [(6, t, "user", "ab"[t % 2]) for t in range(290)]  # two very long ones
    return rows


@pytest.mark.parametrize("block", [1, 4, 7])
def test_against_a_plain_trie(spark, block):
    rows = rows_of(block)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), block) == plain(rows)


def test_many_equal_conversations_and_ids_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN", 16)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 900, 3) for t in range(2)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_table_and_other_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = rows_of(9)[:200]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("place", "digest", "size", "k", "p1", "_turn", "depth", "first", "_range"):
        df = df.withColumn(name, F.lit("mine"))
    assert found(df) == plain(rows)


def test_nodes_have_their_last_turn(spark):
    rows = [(c, t, "user", f"{t}-{c * t // 4}") for c in range(1, 9) for t in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes, _ = M.prefix_trie(*M.rebuilt(M.ordered_turns(df), most=0))
    shown = M.with_last_turn(nodes, df).collect()
    by_id = {(c, t): text for c, t, _, text in rows}
    assert len(shown) == nodes.count()
    assert all(r["text"] == (by_id[r["conv_id"], r["depth"] - 1] if r["depth"] else None) for r in shown)
