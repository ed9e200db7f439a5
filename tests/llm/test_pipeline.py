"""Every stage on its own input, and the whole on a small table."""

import random

import corpus_pipeline
from pitchside.llm import mixing, toxicity

from .helpers import documents, rows
from .test_minhash import brute

SF001 = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_duplicates_keep_one_of_each_group(spark):
    data = [r for r in rows() if r[0] is not None]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, data).select(*COLUMNS), SF001)
    assert kept.columns == COLUMNS
    want = sorted({(i, c) for i, _, c in brute(data) if i == c})
    got = kept.collect()
    assert {r.doc_id for r in got} == {i for i, _ in want}
    assert sum(r.doc_id == 100 for r in got) == 1  # a repeated row of the kept document goes too
    no_id = corpus_pipeline.drop_near_duplicates(spark, documents(spark).select(*COLUMNS), SF001)
    assert sorted(r.text for r in no_id.collect() if r.doc_id is None) == ["no id at all here is some text"]  # the other one is a copy of document 100
    # An id that stands on two texts: the near copy goes, the other text stays.
    long = [f"w{i}" for i in range(100)]
    told = [(1, " ".join(long)), (3, " ".join(["new", *long[1:]])), (3, "another text under that id"), (3, "another text under that id"), (4, ""), (4, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, [(*t, *([None] * 10)) for t in told]).select(*COLUMNS), SF001)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, told[0][1]), (3, told[2][1]), (4, "")]
    assert corpus_pipeline.drop_near_duplicates(spark, documents(spark, []).select(*COLUMNS), SF001).count() == 0


def test_near_copies_from_80_percent_on_go(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    data = []
    for i in range(300):  # one word of 50 changed: 41 of 51 shingles shared; two of them: fewer than 80 %
        text = [r.choice(words) for _ in range(50)]
        other = list(text)
        for k in (20,) if i % 3 else (10, 30):
            other[k] = "new"
        data += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    data = [(*d, *([None] * 10)) for d in data]
    want = {i for i, _, c in brute(data, 80) if i == c}
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, data).select(*COLUMNS), SF001)
    assert {x.doc_id for x in kept.collect()} == want and len(want) == 400


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "mixing_sources", "byte_bpe"]
    clean = corpus_pipeline.written(corpus_pipeline.reject_toxic(spark, docs, SF001), "test")
    model = toxicity.train(docs, spark.read.parquet(f"{SF001}/labels.parquet").where(~toxicity.held_out()))
    low = {r.doc_id for r in toxicity.score(docs, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == low and clean.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, clean, SF001)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in mixing.mix(clean).collect())
    out = corpus_pipeline.encode_bytes(spark, mixed, SF001)
    assert out.count() == mixed.count()
    import hashlib
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in out.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.columns[:3] == ["doc_id", "ids", "n_tokens"] and out.count() > 0
