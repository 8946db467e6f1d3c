import random

import pytest

from lexiloom.llm import common


@pytest.mark.parametrize("few", [0, 50_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rnd = random.Random(few)
    links = [(k, k + 1) for k in range(100, 140)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(500, 500), (-3, 7), (7, -3), (900, 901), (900, 902)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
