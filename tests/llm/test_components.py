import random

import pytest

from tickwise.llm.components import components


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(99, i) for i in range(50)],
    [(i, i * 7 % 40) for i in range(40)], random.Random(3).sample([(a, b) for a in range(80) for b in range(a)], 70)])
def test_components(spark, links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent if root(x) != x}
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(got) == len(want) and {r["u"]: r["low"] for r in got} == want
