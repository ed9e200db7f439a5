"""Held-out accuracy on invented texts; edge rows."""

import random

from pitchside.llm import toxicity

from .helpers import SCHEMA, documents


def corpus(n=900, seed=3):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefghiklmnorstu") for _ in range(r.randint(2, 8))) for _ in range(1500)]
    bad = ["grubbok", "snarfle", "vilmex", "trunkard", "oozling"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 150))]
        toxic = int(r.random() < 0.2)
        for _ in range(r.randint(2, 5) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "s", "ed", "."])
        docs.append((i, " ".join(words), "en", "a", *([None] * 8)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(5000, None, *([None] * 10)), (5001, "", *([None] * 10)), (5002, "word " * 20_000, *([None] * 10)), (None, "grubbok snarfle vilmex", *([None] * 10)), (5003, "grubbok " * 3, *([None] * 10))]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    told = marks.where("doc_id % 3 <> 0 or doc_id is null")
    model = toxicity.train(df, told)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == len({d[0] for d in docs}) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, _, y in labels if i % 3 == 0]
    right = sum((s >= toxicity.THRESHOLD) == (y == 1) for s, y in held) / len(held)
    assert right > 0.95
    assert got[5000] == got[5001] < 0.3 and got[5003] > 0.3 and got[None] > 0.3
    again = {r.doc_id: r.score for r in toxicity.score(df.repartition(5), toxicity.train(df, told)).collect()}
    assert again == got
    kept = toxicity.score(df, model, keep=["lang"])
    assert kept.columns == ["doc_id", "lang", "score"]


def test_without_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, only)).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0
