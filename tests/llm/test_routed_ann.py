"""Routed neighbours against brute force on small tables."""

import numpy as np

from pitchside.llm import routed_ann

SCHEMA = "vec_id long, embedding array<float>, label int, node string, key string, part string, id string, score string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, *["clash"] * 5) for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, top=20):
    """Lists of ``(vec_id, score)`` of every query."""
    out = {}
    for i, v in vectors:
        if i % 20 == 0:
            scores = [(j, float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float)))) for j, w in vectors if j != i and len(w) == len(v)]
            out[i] = sorted(scores, key=lambda s: (-s[1], s[0]))[:top]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def recall(got, want):
    assert set(got) == set(want)
    for q, own in got.items():
        assert len(own) == len(want[q]) and own == sorted(own, key=lambda s: (-s[1], s[0])) and q not in dict(own)
    return sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) / sum(map(len, want.values()))


def query(df, **settings):
    return routed_ann.nearest(df, lambda i: i % 20 == 0, **settings)


def test_recall_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(routed_ann, "ROW_BLOCK", 100)
    monkeypatch.setattr(routed_ann, "QUERY_BLOCK", 10)
    monkeypatch.setattr(routed_ann, "SAMPLE", 600)
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 12)) * 2
    vectors = [(i, (centres[r.integers(30)] + r.normal(size=12) * 0.5).tolist()) for i in range(1500)]
    vectors[40] = (40, [3 * c for c in vectors[40][1]])  # so long that its copies are its nearest
    vectors += [(2000 + i, vectors[40][1]) for i in range(90)]  # more copies than any list holds
    odd = [(3000, None), (3020, [1.0, None] * 6), (3040, [float("nan")] * 12), (3060, [0.0] * 12), (3080, []), (None, vectors[1][1]), (40, vectors[40][1])]
    df = query(frame(spark, vectors + odd))
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = lists(df), brute(vectors)
    assert recall(got, want) >= 0.9
    # All copies have one score, so the smallest ids come first.
    assert [i for i, _ in got[40]] == [i for i, _ in want[40]] == list(range(2000, 2020))
    every = {(q, i): s for q, own in want.items() for i, s in own}
    assert all(abs(s - every[q, i]) < 1e-9 for q, own in got.items() for i, s in own if (q, i) in every)


def test_all_parts_are_exact(spark):
    r = np.random.default_rng(8)
    # Small whole numbers: many vectors share a score.
    vectors = [(i, [float(c) for c in r.integers(-2, 3, size=6)]) for i in range(400)]
    vectors = [(i, v) for i, v in vectors if any(v)] + [(1000 + 20 * i, r.normal(size=3).tolist()) for i in range(5)]
    got = lists(query(frame(spark, vectors), recall=1.1))
    want = brute(vectors)
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in want.items()}
    assert len(got[1000]) == 4


def test_few_and_no_rows(spark):
    assert lists(query(frame(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.5])]))) == {20: [(1, 0.5)]}
    assert query(frame(spark, [(20, [1.0, 0.0])])).count() == 0
    assert query(frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0])])).count() == 0
    got = query(frame(spark, [(20, None)]))
    assert got.count() == 0 and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_parts_are_balanced_and_routes_learnt():
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(16, 8)) * 3, 40, axis=0) + r.normal(size=(640, 8)) * 0.2
    graph = routed_ann.neighbour_graph(x, 16)
    part = routed_ann.balanced_parts(graph, routed_ann.halved(x, 16), 16)
    assert np.bincount(part, minlength=16).max() <= np.ceil(routed_ann.SLACK * 40)
    cut = (part[graph] != part[:, None]).mean()
    assert cut < 0.35
    chances = routed_ann.learnt(x, 16).chances(x)
    # Most neighbours of a vector have the same most probable part.
    own = chances.argmax(axis=1)
    assert (own[graph] == own[:, None]).mean() > 0.6
