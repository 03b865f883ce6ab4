"""Connected components of a graph given as a table of links, as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, functions as F

from quadrille.llm.common import cut, looked_up

#: A graph of so many links is worked on in one task, without a shuffle; larger ones are dealt by node and neighbour.
LINKS = 1 << 17


def components(links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root) for every node with a link; root is the component's smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (Connected
    Components in MapReduce and Beyond, 2014), each a grouped minimum and a join on
    node ids, until the links stop changing. After the last step every link leads
    from a node to its root. The links of each round are kept by a checkpoint; only their count and a checksum come to the
    driver. The number of rounds grows with the logarithm of the longest path.
    """
    now = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        # Steps make no more rows than there are links. Few links take one task, which needs no shuffle. Of more, the neighbours
        # of a node, which may be a hub, are dealt to many runs before they meet the node's smallest neighbour.
        if mark[0] <= LINKS:
            now = now.coalesce(1)
            meet = lambda links, least: links.join(least, "u").coalesce(1)
        else:
            meet = partial(looked_up, key="u", by="v")
        now = cut(_small_star(_large_star(now, meet), meet))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) by the links (u, v) of more and those that roots (node, root) come from."""
    return cut(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def _large_star(links: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = _links(links, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return meet(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return _links(meet(links, least), ("v", "m"), ("u", "m")).where("u <> v").distinct()


def _links(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """(u, v) for each pair of columns of each row."""
    pairs = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])
    return rows.select(F.explode(pairs).alias("_link")).select("_link.u", "_link.v")
