"""Components in one task and in many, against a plain search."""

import random

import pytest

from quadrille.llm import components as C


def plain(links):
    near = {}
    for u, v in links:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    root = {}
    for start in sorted(near):
        ends = [start] if start not in root else []
        while ends:
            node = ends.pop()
            if node not in root:
                root[node] = start
                ends.extend(near[node])
    return root


@pytest.mark.parametrize("each", [1 << 17, 40])
def test_graphs_of_one_task_and_of_many(spark, monkeypatch, each):
    monkeypatch.setattr(C, "LINKS", each)
    draw = random.Random(each)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(90)]  # pairs and chains
    links += [(1000, 1001 + i) for i in range(60)] + [(i + 1, i) for i in range(2000, 2040)]  # a hub and a path
    links = [(u, v) for u, v in links if u != v]
    found = C.components(spark.createDataFrame(links, "u bigint, v bigint").repartition(5)).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == plain(links)
