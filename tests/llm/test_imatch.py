"""Neighbours and edited texts against a sorted list; likenesses of edits and of strangers."""

import hashlib
import random
from collections import Counter

import numpy as np

from pitchside.llm import imatch

from .helpers import SCHEMA, documents, rows


def unique_rows(seed=1):
    seen, out = set(), []
    for r in rows(seed):
        if r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def test_against_a_sorted_list(spark):
    data = unique_rows()
    got = {r.doc_id: r for r in imatch.fingerprints(documents(spark, data)).collect()}
    order = sorted(data, key=lambda d: (d[0] is None, -(d[0] or 0)))
    assert len(got) == len(data)
    prints = {}
    for k, d in enumerate(order):
        text, following = d[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        new = text[:len(text) - cut] + following[:cut]
        r = got[d[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
        if text == following:
            assert r.near_next == 1.0


def test_lexicon_counts_documents(spark):
    data = rows()
    counts = Counter(w for d in data for w in {imatch.TermHashes()[t] for t in (d[1] or "").encode().lower().split()})
    n = len(data)
    low, high = max(2, n * 0.05), max(2, n * 0.5)
    want = sorted(h for h, c in counts.items() if low <= c <= high)
    assert imatch.lexicon(documents(spark, data), "text", 0.05, 0.5).tolist() == want
    merged = [(t, c) for r in imatch.document_frequencies(documents(spark, data), flush=50).collect()
              for t, c in zip(imatch._unpack_terms(r.terms).tolist(), imatch.unpack_counts(r.counts).tolist(), strict=True)]
    assert dict(merged) == dict(counts) and len(merged) == len(counts)


def test_texts_with_words_have_fingerprints():
    lexicon, hashes = np.empty(0, np.uint64), imatch.TermHashes()
    prints = {".".join(imatch.fingerprint(imatch.terms_of(f"w{i}", hashes), lexicon)).strip(".") for i in range(300)}
    assert len(prints) == 300 and "" not in prints  # one-word texts: each its own
    assert set(imatch.fingerprint(imatch.terms_of(" ", hashes), lexicon)) == {""}


def test_counts_beyond_32_bits():
    big = np.array([1, 2**32 + 5, 2**40], np.int64)
    assert imatch.unpack_counts(imatch.pack_counts(big)).tolist() == big.tolist()


def test_slices_follow_the_documents(spark):
    assert [imatch.slice_bits(n) for n in (0, 1000, 10**6, 10**10)] == [8, 8, 10, 17]
    counts = lambda bits: {t: c for r in imatch.document_frequencies(documents(spark), flush=50, bits=bits).collect()
                           for t, c in zip(imatch._unpack_terms(r.terms).tolist(), imatch.unpack_counts(r.counts).tolist(), strict=True)}
    assert counts(8) == counts(12)


def test_an_id_on_several_texts(spark):
    data = rows()  # ids 3 and 100 twice, and two rows without one
    got = imatch.fingerprints(documents(spark, data)).collect()
    digest = lambda r: (str(r[0]), len(r[1] or ""))
    assert sorted((str(g.doc_id), g.n_chars) for g in got) == sorted(map(digest, data))
    again = imatch.fingerprints(documents(spark, data).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edits_are_nearer_than_strangers(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    data = [(i, " ".join(words[min(2999, int(r.expovariate(1 / 400)))] for _ in range(r.choice([40, 300, 2500]))), *([None] * 10)) for i in range(200)]
    got = imatch.fingerprints(spark.createDataFrame(data, SCHEMA)).collect()
    a, b = np.array([x.near_edited for x in got]), np.array([x.near_next for x in got])
    assert (a > b).mean() > 0.93 and ((a >= 0) & (a <= 1)).all()


def test_small_tables(spark):
    assert imatch.fingerprints(documents(spark, [])).count() == 0
    one = imatch.fingerprints(documents(spark, [rows()[0]])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
