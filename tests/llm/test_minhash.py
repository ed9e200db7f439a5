"""Components against all pairs; copies, chains, hubs and long texts."""

import random

from pitchside.llm import minhash

from .helpers import SCHEMA, ascii_words, documents, rows


def brute(data, percent=85):
    sets = []
    for d in data:
        w = ascii_words(d[1])
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = {}
    for i, d in enumerate(data):
        if d[0] is not None:
            ids.setdefault(find(i), []).append(d[0])
    return sorted(((d[0], len(sets[i]), min(ids.get(find(i), [d[0]]), default=None)) for i, d in enumerate(data)), key=str)


def found(df):
    got = minhash.near_duplicates(df).collect()
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)
    return sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str)


def test_awkward_rows(spark):
    assert found(documents(spark)) == brute(rows())


def test_hub_with_copies_that_are_not_alike(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(300)]
    data = [(50, " ".join(base))]
    for i in range(40):
        w = list(base)
        for k in r.sample(range(300), 4):
            w[k] = f"new{i}_{k}"
        data.append((i if i < 20 else 100 + i, " ".join(w)))
    chain = [r.choice(words) for _ in range(120)]
    for i in range(12):
        data.append((300 + i, " ".join(chain)))
        chain[i * 10 + 5] = f"link{i}"
    data = [(*d, *([None] * 10)) for d in data]
    got = found(spark.createDataFrame(data, SCHEMA))
    assert got == brute(data)
    assert {c for i, _, c in got if i < 200} == {0} and {c for i, _, c in got if i >= 300} == {300}


def test_blocks_without_members(spark, monkeypatch):
    """Two long texts that share buckets, are not linked, and make more blocks than there are members."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    r = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    one = [r.choice(words) for _ in range(2000)]
    two = list(one)
    for k in range(0, 2000, 30):
        two[k] = f"new{k}"
    three = [r.choice(words) for _ in range(2000)]
    data = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(three)), (4, " ".join([*three[:1000], "new", *three[1001:]]))]
    data = [(*d, *([None] * 10)) for d in data]
    got = found(spark.createDataFrame(data, SCHEMA))
    assert got == brute(data) and [c for _, _, c in got] == [1, 2, 3, 3]


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
