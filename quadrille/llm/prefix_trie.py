"""A trie of conversations: every distinct sequence of first turns is a node.

Conversations are cut into blocks of ``block`` turns. A block is known by what leads up
to it and by its own turns: the sum of the hashes of all (place, turn) up to its end, in
128 bits, which a running sum gives for a conversation of any length. So conversations
are first grouped block by block. Inside a block all its conversations go the same way;
turn boundaries are looked at only where several blocks follow the same one, to find the
turn at which these siblings part, and there each distinct block is one row, however many
conversations it has.

What is summed over subtrees needs no walk. A conversation saves those of its turns
whose node also belongs to a smaller conversation, and it ends in a leaf of its own or
not; a node has the sum, over its conversations, of what they save from its depth on. So
these are running sums from the end of each conversation, grouped by block and then by
turn.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.functions.ordering import running_within
from quadrille.llm.common import cut, looked_up, table

#: Turns in a block.
BLOCK = 4
#: A node's conversations are written out in runs of so many ids.
RUN = 4096
KEY = ["depth", "s1", "s2"]


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, digest, size) for each row: its place in its conversation, from 0, by turn (null first, then by
    role and digest), the SHA-256 of role and text, and the text's code points.

    A null role or text counts as empty. Rows without a conv_id belong to no conversation and are left out.
    Rows that repeat a turn are turns of their own.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), who.alias("_role"), digest.alias("digest"), F.char_length(said).cast("long").alias("size"))
    placed = running_within(rows, "conv_id", [F.col("_turn").asc_nulls_first(), "_role", "digest"], {"place": F.lit(1).cast("long")})
    return placed.select("conv_id", (F.col("place") - 1).alias("place"), "digest", "size")


def rebuilt(turns: DataFrame, shared: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) that share beginnings: of each conversation the first h turns become those of the
    first of its shared ids, h = crc32(id) % (most + 1); all if that one has fewer, none if there is none.

    All conversations are given, also those that have no turns left.
    """
    turns = cut(turns)
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1), F.col("conv_id") - F.col("conv_id") % shared
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).select("conv_id", h.alias("_h"), base.alias("_base"))
    heads = turns.where((F.col("place") < most) & (base == F.col("conv_id"))).withColumnRenamed("conv_id", "_base")
    given = heads.groupBy("_base").agg(F.count(F.lit(1)).alias("_given"))
    convs = cut(convs.join(given, "_base", "left").withColumn("_given", F.least("_h", F.coalesce("_given", F.lit(0)))))
    # A base has at most 2 * shared ids. A conversation of very many turns is one that Spark's join splits.
    from_base = convs.join(heads, "_base").where("place < _h").select("conv_id", "place", "digest", "size")
    own = turns.join(convs, "conv_id").where("place >= _h").select("conv_id", (F.col("place") - F.col("_h") + F.col("_given")).alias("place"), "digest", "size")
    return convs.select("conv_id"), from_base.unionByName(own)


def _blocks(convs: DataFrame, turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, k, turns, size, p1, p2): a conversation's k-th block, with the sums of hashes up to its end. Each conversation
    begins with the block -1, which holds the textless root alone."""
    words = [F.xxhash64(F.lit(i), "place", "digest") for i in (1, 2)]
    placed = turns.select("conv_id", F.floor(F.col("place") / block).cast("long").alias("k"), F.struct("place", *[w.alias(f"w{i}") for i, w in enumerate(words, 1)], "size", "digest").alias("_t"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    cut_up = placed.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list("_t")).alias("turns"), F.sum("_t.size").alias("size"), wide("_t.w1").alias("b1"), wide("_t.w2").alias("b2"))
    nothing = F.struct(F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("digest"))
    zero = F.lit(0).cast("decimal(30,0)")
    roots = convs.select("conv_id", F.lit(-1).cast("long").alias("k"), F.array(nothing).alias("turns"), F.lit(0).cast("long").alias("size"), zero.alias("b1"), zero.alias("b2"))
    return running_within(roots.unionByName(cut_up), "conv_id", ["k"], {"p1": F.col("b1"), "p2": F.col("b2")}).drop("b1", "b2")


def _boundaries(distinct: DataFrame) -> DataFrame:
    """The rows of distinct blocks, one for each turn: its node's key and that of its parent, with size and digest."""
    wide = lambda c: c.cast("decimal(38,0)")
    after = lambda i, w: F.col(f"p{w}") - F.aggregate(F.slice("turns", i + 2, F.size("turns")), wide(F.lit(0)), lambda sofar, t: wide(sofar + t[f"w{w}"]))
    each = F.transform("turns", lambda t, i: F.struct((i + 1).alias("at"), (t["place"] + 1).alias("depth"), wide(after(i, 1)).alias("s1"), wide(after(i, 2)).alias("s2"), t["w1"].alias("w1"), t["w2"].alias("w2"), t["size"].alias("_size"), t["digest"].alias("digest")))
    return distinct.withColumn("_e", F.explode(each)).select(*distinct.columns, "_e.*")


def prefix_trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends). convs has all conv_id once, turns the rows (conv_id, place, digest, size), places from 0 without gaps.

    nodes: depth, s1, s2 (which together name a node), conv_id (its smallest conversation), parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its subtree, size times one less
    than n_convs), digest (of its last turn; empty for the root). ends: depth, s1, s2 and conv_id of the node that each
    conversation ends at. Without conversations there are no nodes.
    """
    rows = _blocks(convs, turns, block)
    group = ["k", "p1", "p2"]
    distinct = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first"), F.first("turns").alias("turns"))
    wide = lambda c: c.cast("decimal(38,0)")
    own = lambda w: F.aggregate("turns", wide(F.lit(0)), lambda sofar, t: wide(sofar + t[f"w{w}"]))
    before = F.struct("k", wide(F.col("p1") - own(1)).alias("q1"), wide(F.col("p2") - own(2)).alias("q2"))
    distinct = cut(distinct.withColumn("_after", before))
    parting = distinct.groupBy("_after").agg((F.count(F.lit(1)) > 1).alias("parts"))
    distinct = cut(looked_up(distinct, parting, "_after", "first").drop("_after"))

    # Nodes: where blocks have siblings by turn, else straight from the block.
    each = _boundaries(distinct)
    facts = [*KEY, "w1", "w2", "digest", "_size"]
    alone = each.where("NOT parts").select(*facts, F.col("first").alias("conv_id"), "n_convs")
    met = each.where("parts").groupBy(*KEY).agg(*[F.first(c).alias(c) for c in facts[3:]], F.min("first").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    nodes = alone.unionByName(met)
    up = [(F.col("depth") - 1).alias("depth"), wide(F.col("s1") - F.col("w1")).alias("s1"), wide(F.col("s2") - F.col("w2")).alias("s2")]
    nodes = cut(nodes.withColumn("_up", F.when(F.col("depth") > 0, F.struct(*up))))
    children = nodes.where("_up IS NOT NULL").groupBy("_up").agg(F.count(F.lit(1)).alias("n_children")).select("_up.*", "n_children")
    nodes = cut(nodes.join(children, KEY, "left").fillna(0, ["n_children"]))

    # From which turn on a distinct block's nodes are its first conversation's own: the key holds that conversation, so no key is hot.
    mine = each.where("parts").join(nodes.select(*KEY, F.col("conv_id").alias("first")), [*KEY, "first"])
    mine = mine.groupBy("k", "first").agg(F.min("at").alias("own_from"), F.sum("_size").alias("own_size"))
    whole = distinct.where("NOT parts").select("k", "first", F.lit(1).alias("own_from"), F.aggregate("turns", F.lit(0).cast("long"), lambda sofar, t: sofar + t["size"]).alias("own_size"))
    owned = cut(mine.unionByName(whole))
    last = F.when(F.col("depth") == 0, -1).otherwise(F.floor((F.col("depth") - 1) / block)).cast("long")
    leaves = nodes.where("n_children = 0").select(last.alias("k"), "conv_id", F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("own_size"))
    extra = owned.select("k", F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("leaf"), "own_size").unionByName(leaves).groupBy("k", "conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("own_size").alias("own_size"))
    saving = rows.select("conv_id", *group, "size", (F.element_at("turns", -1)["place"] + 1).alias("depth")).join(extra, ["conv_id", "k"], "left").fillna(0, ["leaf", "own_size"])
    saving = saving.withColumn("saves", F.col("size") - F.col("own_size"))
    suffix = running_within(saving.drop("size", "own_size"), "conv_id", [F.col("k").desc()], {"_leaves": F.col("leaf"), "_saves": F.col("saves"), "_nth": F.lit(1)})
    suffix = cut(suffix)
    ends = suffix.where("_nth = 1").select("depth", wide(F.col("p1")).alias("s1"), wide(F.col("p2")).alias("s2"), "conv_id")

    # Sums by block, then by turn: a block's turns from there on, less those of its first conversation that are its own.
    beyond = suffix.groupBy(*group).agg(F.sum("_leaves").alias("n_leaves"), F.sum(F.col("_saves") - F.col("saves")).alias("beyond"))
    summed = distinct.join(beyond, group).join(owned.drop("own_size"), ["k", "first"], "left")
    within = F.transform("turns", lambda t, i: t["size"] * (F.col("n_convs") - F.when(i + 1 >= F.col("own_from"), 1).otherwise(0)))
    summed = _boundaries(summed.withColumn("_within", within))
    saved = F.col("beyond") + F.aggregate(F.slice("_within", F.col("at"), F.size("_within")), F.lit(0).cast("long"), lambda sofar, s: sofar + s)
    summed = summed.select(*KEY, "parts", "n_leaves", saved.alias("saved_tokens"))
    sums = summed.where("NOT parts").drop("parts").unionByName(summed.where("parts").groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    nodes = nodes.join(sums, KEY)
    parents = nodes.select(F.struct(*KEY).alias("_up"), F.col("conv_id").alias("parent_conv_id"))
    below = looked_up(nodes.where("_up IS NOT NULL"), parents, "_up", "conv_id")
    top = nodes.where("_up IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top).select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "digest"), ends


def with_last_turn(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes with the role and text of their last turn, by its digest; null for the root."""
    said, who = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), 256))
    texts = conversations.select(digest.alias("digest"), who.alias("role"), said.alias("text")).dropDuplicates(["digest"])
    return looked_up(nodes, texts, "digest", "conv_id").unionByName(nodes.where("depth = 0").select("*", *[F.lit(None).cast("string").alias(c) for c in ("role", "text")]))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256): the SHA-256 of the ids that end at each node, ascending and joined by commas.

    A digest is made front to back, so a node's ids pass through one task, but as runs of RUN neighbouring ids
    that are joined before, one at a time.
    """
    runs = ends.groupBy(*KEY, F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    sorted_runs = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run")

    def digest(batches):
        now, made, schema = None, None, None
        for batch in batches:
            schema, out = batch.schema, []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            for key, ids in zip(keys, batch.column(4)):
                if key == now:
                    made.update(b",")
                else:
                    if now is not None:
                        out.append((*now, made.hexdigest()))
                    now, made = key, hashlib.sha256()
                made.update(ids.as_py().encode())
            if out:
                yield _batch(out, schema)
        if now is not None:
            yield _batch([(*now, made.hexdigest())], schema)

    return sorted_runs.mapInArrow(digest, "depth bigint, s1 decimal(38,0), s2 decimal(38,0), ends_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    types = [schema.field(i).type for i in range(3)] + [pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*KEY, "ends_sha256"])


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie(*rebuilt(ordered_turns(table(spark, sf_dir, "conversations"))))
    return nodes.join(ends_digests(ends), KEY, "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: The paths are compared with each other, so this is for small tables. The first part is crc32, bit by bit.
OP12_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), 4294967295)) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, place AS seq, role, text FROM c JOIN t ON t.conv_id = base AND place < h UNION ALL SELECT c.conv_id, 5 + place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place >= h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS depth, length(text) AS size, sha256(length(role) || ':' || role || text) AS d FROM r),
q AS (SELECT conv_id, depth, size, array_to_string(list(d) OVER (PARTITION BY conv_id ORDER BY depth), '') AS path FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, CASE WHEN depth > 0 THEN left(path, CAST(64 * (depth - 1) AS BIGINT)) END AS up FROM q GROUP BY path, depth),
k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
g AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path),
s AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved_tokens FROM g a JOIN g b ON starts_with(b.path, a.path) GROUP BY a.path),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, depth) AS path FROM q GROUP BY conv_id) GROUP BY path)
SELECT g.conv_id, g.depth, o.conv_id AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM g JOIN s ON s.path = g.path LEFT JOIN g o ON o.path = g.up LEFT JOIN e ON e.path = g.path
"""
