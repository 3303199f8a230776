"""Connected components against a plain search, with one partition and with many."""

import random

import pytest

import tessera.llm.components as c


@pytest.mark.parametrize("local", [1_000_000, 40])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(c, "LOCAL_EDGES", local)
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(120)] + [(-5, 2000 + k) for k in range(50)] + [(7, 7), (3000, 3001), (3000, 3001)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, left = {}, set(near)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        left -= group
        want |= {x: min(group) for x in group}
    got = c.components(spark.createDataFrame(edges, "a long, b long").repartition(12))
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and dict(rows) == want
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0
