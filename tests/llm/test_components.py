"""Connected components against a plain search of the graph."""

import random

import pytest

from indexwright.llm.components import components

CHAIN = [(i, i + 1) for i in range(40)]
HUB = [(7, i) for i in range(8, 200)] + [(i, 7) for i in range(60)]
RING = [(i, (i + 1) % 25) for i in range(25)]
_RANDOM = random.Random(3)
SPARSE = [(_RANDOM.randrange(300), _RANDOM.randrange(300)) for _ in range(170)]


def _search(edges):
    around = {}
    for a, b in edges:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    found = {}
    for first in sorted(around):
        if first in found:
            continue
        todo = [first]
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = first
                todo += around[node]
    return found


@pytest.mark.parametrize("edges", [CHAIN, HUB, RING, SPARSE, [], [(4, 4)], [(2, 1), (1, 2), (2, 1)], [(1, 2), (3, 4), (9, 2)]],
                         ids=["chain", "hub", "ring", "sparse", "empty", "loop", "repeated", "two"])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == _search(edges)
