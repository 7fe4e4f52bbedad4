from __future__ import annotations

import random

import pytest

from panelspark.llm.components import components


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    r = random.Random(2)
    edges = {"random": [(r.randrange(300), r.randrange(300)) for _ in range(160)], "path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(400)], "none": [(1, 1)]}[kind]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((x, root(x)) for x in {z for a, b in edges if a != b for z in (a, b)})
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(tuple(x) for x in got) == want
