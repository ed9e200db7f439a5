import random

from pitchside.llm.components import connected_components


def test_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(40)]
    edges += [(5, 5), (9999, 9999), (None, 3), (4, None), (7, 8), (7, 8), (8, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {x: find(x) for x in parent}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
