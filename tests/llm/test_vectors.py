"""Links against all pairs; recall of the graph; awkward vectors."""

import numpy as np

from pitchside.llm import vectors as V


def brute(data, threshold=0.93):
    ok = [i for i, (_, v, label) in enumerate(data) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(data))}
    for a in ok:
        for b in ok:
            if a != b and data[a][2] == data[b][2] and len(data[a][1]) == len(data[b][1]):
                x, y = np.array(data[a][1], float), np.array(data[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a].add(b)
    out = []
    for i, d in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        out.append((d[0], len(links[i]), min(ids, default=None)))
    return sorted(out, key=str)


def found(spark, data, **k):
    df = spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in data], "vec_id long, embedding array<float>, label int, key string, copies string").repartition(3)
    got = V.near_vectors(df, **k).collect()
    assert all(g.kept == (g.vec_id == g.component_id) for g in got)
    return sorted(((g.vec_id, g.n_links, g.component_id) for g in got), key=str)


def sample(n=300, dim=8, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(25, dim))
    data = [(int(i), (centres[i % 25] + r.normal(size=dim) * r.choice([0.05, 0.2, 0.5])).astype(np.float32).tolist(), int(i % 3)) for i in r.permutation(n)]
    data += [(1000 + i, data[0][1], data[0][2]) for i in range(6)] + [(1010, [2 * x for x in data[0][1]], data[0][2])]
    return data + [(2000, None, 0), (2001, [], 0), (2002, [0.0] * dim, 0), (2003, [1.0, None] + [0.0] * (dim - 2), 0), (2004, [float("nan")] * dim, 0), (2005, [float("inf")] * dim, 0),
                   (2006, data[0][1], None), (2007, data[0][1][:4], data[0][2]), (None, data[0][1], data[0][2]), (3, data[5][1], data[5][2]), (2008, [1e30] * dim, 0), (2009, [1e-30] * dim, 0)]


def test_against_all_pairs(spark):
    data = sample()
    assert found(spark, data) == brute(data)


def test_many_shards(spark):
    data = sample(240)
    assert found(spark, data, shard=20) == brute(data)


def test_recall_of_the_graph():
    r = np.random.default_rng(9)
    x = r.normal(size=(1500, 16))
    x[:700] = x[0] + 0.15 * r.normal(size=(700, 16))  # a tight cluster, far more than a beam holds
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = V.Graph.build(x)
    truth = x @ x.T >= 0.93
    got = V.audited_links(V.Graph.from_bytes(x, graph.to_bytes()), x, 0.93)
    hits = sum(truth[i][f].sum() for i, f in enumerate(got))
    assert hits >= 0.99 * truth.sum()
    assert all(truth[i][f].all() for i, f in enumerate(got))


def test_groups_of_a_block():
    r = np.random.default_rng(4)
    for shape, share in (((30, 40), 0.03), ((25, 25), 0.02), ((1, 6), 0.5), ((5, 3), 0.0)):
        marks = r.random(shape) < share
        got = sorted((sorted(a.tolist()), sorted(b.tolist())) for a, b in V.block_groups(marks))
        want, left = [], set(np.flatnonzero(marks.any(axis=1)).tolist())
        while left:
            a, b, todo = set(), set(), [min(left)]
            while todo:
                i = todo.pop()
                if i not in a:
                    a.add(i)
                    b |= set(np.flatnonzero(marks[i]).tolist())
                    todo += [k for j in b for k in np.flatnonzero(marks[:, j]).tolist() if k not in a]
            left -= a
            want.append((sorted(a), sorted(b)))
        assert got == sorted(want)


def test_query_reads_the_whole_table(spark, tmp_path):
    data = sample(150)
    df = spark.createDataFrame([(i, v, label) for i, v, label in data], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = V.op2_embedding_near_dedup(spark, str(tmp_path)).collect()
    assert sorted(((g.vec_id, g.n_links, g.component_id) for g in got), key=str) == brute(data)
    assert all(g.kept == (g.vec_id == g.component_id) for g in got)


def test_a_group_of_near_copies_costs_a_row_each(spark):
    r = np.random.default_rng(11)
    centre = r.normal(size=12)
    data = [(i, (centre + 0.02 * r.normal(size=12)).tolist(), 1) for i in range(400)]
    assert found(spark, data, shard=90) == [(i, 399, 0) for i in sorted(range(400), key=lambda i: str((i, 399, 0)))]


def test_empty_table(spark):
    assert found(spark, []) == []
