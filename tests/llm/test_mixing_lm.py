"""Counts and base scores against a counter; probabilities that sum to one; better than the base on held-out text."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pitchside.llm import mixing_lm as lm

from .helpers import ascii_words, documents, rows


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_counts_and_base_scores(spark):
    data = rows()
    got = lm.score_texts(documents(spark, data), lm.held_out(), limit=4000).collect()
    counts = Counter(t for d in data if not is_held(d[0]) for t in [*ascii_words(d[1]), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d in data:
        tokens = [*ascii_words(d[1]), None]
        want.append((str(d[0]), is_held(d[0]), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), 6)))
    assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == sorted(want)
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)
    by = {}
    for g, d in ((g, next(x for x in data if x[0] == g.doc_id)) for g in got if g.doc_id in (100, 101)):
        by[g.doc_id] = g.score
    assert by[100] == by[101]  # one text, one score


def test_units_cut_a_text_and_nothing_else():
    for text in (None, "", "a", "a b", " a\n\nB ", "x y\tz", "\n"):
        units = lm.units_of(text)
        data = (text or "").encode().lower()
        assert b"".join(units) == data + b"  " and units[-1].endswith(b"  ")
        assert [w for w in map(lm.word_of, units) if w] == data.split()


def test_units_are_counted_in_one_pass_over_the_texts(monkeypatch):
    rng = np.random.default_rng(3)
    learnt = [(int(e), rng.integers(0, 50_000, 5).astype(np.uint32)) for e in rng.integers(0, 2, 300)]
    want = np.zeros((3, 50_000), np.int64)
    for expert, seq in learnt:
        np.add.at(want[expert], seq, 1)
    made, real = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: made.append(len(out := real(*a, **b))) or out)
    assert (lm.unit_counts(learnt, 3, 50_000) == want).all() and sum(made) <= 3 * 50_000
    assert lm.unit_counts([], 1, 0).shape == (1, 0)


def test_shared_beginnings_are_coded_once():
    units = sorted([b"ab ", b"abc ", b"abc  ", b"abd\n", b" ", b"  ", b"b ", b"x" * 3000 + b" ", b"x" * 3000 + b"  "])
    codes = lm.huffman(np.ones(257))
    bits = lm.Bits(units, codes)
    symbols = [[*u[:-2], lm.END] if u[-2:] == b"  " else list(u) for u in units]
    seen = {}
    for s in symbols:
        for k in range(len(s)):
            seen.setdefault(tuple(s[:k + 1]), len(seen))
    assert bits.symbols == len(seen)
    counts = np.arange(1, len(units) + 1)
    want = [sum(int(c) for s, c in zip(symbols, counts, strict=True) if tuple(s[:len(p)]) == p) for p in seen]
    assert bits.weights(counts).tolist() == want
    costs = np.random.default_rng(1).random((len(seen), 2))
    total = [sum(costs[seen[tuple(s[:k + 1])]] for k in range(len(s))) for s in symbols]
    assert np.allclose(bits.totals(costs), total)


def test_next_symbols_sum_to_one():
    rng = np.random.default_rng(2)
    tables = tuple(rng.integers(0, 50, (1 << b, 2)).astype(np.float32) for b in lm.TABLE_BITS)
    model = lm.Model(lm.huffman(rng.integers(0, 100, 257)), tables, rng.normal(0.2, 0.1, (lm.GATES, lm.INPUTS)))
    scorer = lm.Scorer(model, 2)
    # All units that are one symbol long after the prefix "ab": white space or the end; and all two-symbol paths that are not units.
    prefix = [97, 98]
    every = [bytes([*prefix, x]) for x in range(256)] + [b"ab  "]
    whole = 10 ** scorer.log10(every) / 10 ** scorer.log10([b"ab"])
    assert whole.sum(axis=0) == pytest.approx([1.0, 1.0], abs=1e-5)


def test_counts_and_spelling_sum_to_one():
    rng = np.random.default_rng(3)
    spelt = rng.dirichlet(np.ones(50), 2).T  # all units there are, by two experts
    counts = rng.integers(0, 4, (50, 2)) * np.array([1, 0])  # the second has learnt nothing
    got = 10 ** lm.with_counts(np.log10(spelt), counts, counts.sum(axis=0).astype(float), (counts == 1).sum(axis=0).astype(float))
    assert got.sum(axis=0) == pytest.approx([1.0, 1.0])
    new = (counts[:, 0] == 1).sum() + 1
    assert got[:, 0] == pytest.approx((counts[:, 0] + new * spelt[:, 0]) / (counts[:, 0].sum() + new))
    assert got[:, 1] == pytest.approx(spelt[:, 1])


def plain_score(texts, learnt, scorer, experts):
    """Text by text and unit by unit, with counters; ``learnt`` are (expert, text)."""
    counts = [Counter(u for e, t in learnt if e == k for u in lm.units_of(t)) for k in range(experts)]
    out = []
    for text in texts:
        each = [math.log(1 / experts)] * experts
        for u in lm.units_of(text):
            spelt = scorer.log10([u])[0]
            for k in range(experts):
                new, n = sum(c == 1 for c in counts[k].values()) + 1, sum(counts[k].values())
                each[k] += math.log((counts[k][u] + new * 10 ** spelt[k]) / (n + new))
        top = max(each)
        out.append((top + math.log(sum(math.exp(x - top) for x in each))) / math.log(10))
    return out


def test_scores_against_a_plain_scorer(spark, monkeypatch):
    data = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 3 + i % 9)), ["en", "de"][i % 2], "a", *([None] * 8)) for i in range(60)] + [(60, None, "en", *([None] * 9))]
    docs = documents(spark, data).coalesce(1)
    learn, kept = lm._learn_weights, []  # the weights depend a little on how the units are divided into tasks
    monkeypatch.setattr(lm, "_learn_weights", lambda *a: kept.append(learn(*a)) or kept[-1])
    got = {g.doc_id: g for g in lm.score_texts(docs, lm.held_out()).collect()}
    trained = Counter(d[2] for d in data if not is_held(d[0]))
    groups = sorted(trained, key=lambda g: (-trained[g], g))
    learnt = [(groups.index(d[2]), d[1]) for d in data if not is_held(d[0])]
    units = lm._merged_units(lm._unit_blocks(docs, "doc_id", "text", "lang", lm.held_out(), groups, 10**6), 2)
    model = lm.Model(lm.huffman(lm._symbol_counts(units, 2)))
    model = lm.replace(model, tables=lm._count_tables(units, model.codes, 2))
    # Every bit of every training unit is counted once for each predictor.
    bits = sum(int((model.codes[s] >= 0).sum()) for _, t in learnt for u in lm.units_of(t) for s in ([*u[:-2], lm.END] if u[-2:] == b"  " else u))
    assert [int(t.sum()) for t in model.tables] == [bits] * len(lm.TABLE_BITS)
    want = plain_score([d[1] for d in data], learnt, lm.Scorer(lm.replace(model, weights=kept[0]), 2), 2)
    for d, w in zip(data, want, strict=True):
        g, n = got[d[0]], len((d[1] or "").encode())
        assert g.score == pytest.approx(w, rel=1e-4)
        assert g.total_bits == pytest.approx(-g.score * math.log2(10))
        assert g.bits_per_byte is None if n == 0 else g.bits_per_byte == pytest.approx(g.total_bits / n)


def test_query_scores_the_whole_table(spark, tmp_path):
    data = rows()
    documents(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = lm.op4_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted(str(g.doc_id) for g in got) == sorted(str(d[0]) for d in data)
    assert {g.held_out for g in got if is_held(g.doc_id)} == {True}


def test_held_out_text_is_predicted(spark):
    """Words of a text's own language, and new words made of known parts, which the base only knows as unknown."""
    import random

    r = random.Random(8)
    parts = {g: ["".join(r.choice(letters) for _ in range(3)) for _ in range(12)] for g, letters in (("en", "aeiouthn"), ("de", "zkpwxyq"))}
    data = []
    for i in range(500):
        g = r.choice(["en", "de"])
        data.append((i, " ".join("".join(r.choice(parts[g]) for _ in range(r.randint(1, 3))) for _ in range(60)), g, "a", *([None] * 8)))
    got = [g for g in lm.score_texts(documents(spark, data), lm.held_out()).collect() if g.held_out]
    assert sum(g.score for g in got) > sum(g.base_score for g in got)
    assert sum(g.score > g.base_score for g in got) > 0.9 * len(got)


def test_words_that_begin_alike_are_spread_over_slices(spark):
    data = [(i, " ".join(f"https://h/{i}/{k}" for k in range(100)), "en", "a", *([None] * 8)) for i in range(40)]
    blocks = lm._unit_blocks(documents(spark, data), "doc_id", "text", "lang", lm.held_out(), ["en"], 10_000)
    sizes = [len(lm.unpack_words(r.words)) for r in lm._merged_units(blocks, 1).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 100


def test_empty_table(spark):
    assert lm.score_texts(documents(spark, []), lm.held_out()).count() == 0


def plain_pair_score(texts, learnt, scorer, experts):
    """As ``plain_score``, each unit after the one before it (None at a start)."""
    alone = [Counter(u for e, t in learnt if e == k for u in lm.units_of(t)) for k in range(experts)]
    pairs = [Counter(p for e, t in learnt if e == k for p in zip([None, *lm.units_of(t)], lm.units_of(t))) for k in range(experts)]
    before = [Counter() for _ in range(experts)]
    for k in range(experts):
        for (a, _), n in pairs[k].items():
            before[k][a] += n
    power = [sum(n == 1 for n in p.values()) / max(len(p), 1) for p in pairs]
    scale = [len(pairs[k]) / max(sum(n ** power[k] for n in before[k].values()), 1e-300) for k in range(experts)]
    out = []
    for text in texts:
        each = [math.log(1 / experts)] * experts
        units = lm.units_of(text)
        for a, u in zip([None, *units], units):
            spelt = scorer.log10([u])[0]
            for k in range(experts):
                new, n = sum(c == 1 for c in alone[k].values()) + 1, sum(alone[k].values())
                p = (alone[k][u] + new * 10 ** spelt[k]) / (n + new)
                kinds = scale[k] * before[k][a] ** power[k] if before[k][a] else 1
                each[k] += math.log((pairs[k][a, u] + kinds * p) / (before[k][a] + kinds))
        top = max(each)
        out.append((top + math.log(sum(math.exp(x - top) for x in each))) / math.log(10))
    return out


def test_scores_after_the_unit_before_against_a_plain_scorer(spark, monkeypatch, tmp_path):
    """The query's scores, in many blocks and slices; texts of the same units in another order score apart."""
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    data = [(i, " ".join(words[(i + k * (1 + i % 2)) % 5] for k in range(2 + i % 9)), ["en", "de"][i % 2], "a", *([None] * 8)) for i in range(60)]
    data += [(60, None, "en", *([None] * 9)), (61, "alpha beta gamma", "en", "a", *([None] * 8)), (62, "gamma alpha beta", "en", "a", *([None] * 8)), (63, "beta new alpha", "fr", "a", *([None] * 8))]
    docs = documents(spark, data).coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    learn, kept = lm._learn_weights, []
    monkeypatch.setattr(lm, "_learn_weights", lambda *a: kept.append(learn(*a)) or kept[-1])
    got = {g.doc_id: g for g in lm.op4_lm_scoring(spark, str(tmp_path)).collect()}
    trained = Counter(d[2] for d in data if not is_held(d[0]))
    groups = sorted(trained, key=lambda g: (-trained[g], g))
    learnt = [(groups.index(d[2]), d[1]) for d in data if not is_held(d[0])]
    n = len(groups)
    units = lm._merged_units(lm._unit_blocks(docs, "doc_id", "text", "lang", lm.held_out(), groups, 10**6), n)
    model = lm.Model(lm.huffman(lm._symbol_counts(units, n)))
    model = lm.replace(model, tables=lm._count_tables(units, model.codes, n))
    want = plain_pair_score([d[1] for d in data], learnt, lm.Scorer(lm.replace(model, weights=kept[0]), n), n)
    for d, w in zip(data, want, strict=True):
        assert got[d[0]].score == pytest.approx(w, rel=1e-4)
    assert got[61].score != pytest.approx(got[62].score, rel=1e-3)
    # Blocks of a few texts, dealt over tasks: the same pairs are counted.
    many = {g.doc_id: g.score for g in lm.score_texts(documents(spark, data), lm.held_out(), limit=300, pairs=True).collect()}
    assert all(many[k] == pytest.approx(g.score, rel=0.02) for k, g in got.items())


def test_units_after_another_sum_to_one():
    rng = np.random.default_rng(5)
    alone = rng.dirichlet(np.ones(40))
    for pairs in (rng.integers(0, 5, 40), np.zeros(40, np.int64)):
        for before in (0, -1):  # after a unit, and at a text's start
            occurs = np.zeros(41)
            occurs[before] = pairs.sum()
            got = np.exp(lm.after_another(np.log(alone), occurs, 0.7, 1.3, np.full(40, before), np.arange(40), pairs))
            assert got.sum() == pytest.approx(1.0)
            if not pairs.any():
                assert got == pytest.approx(alone)
    # A unit whose probability is no number any more.
    assert lm.after_another(np.array([-9000.0]), np.array([3, 2]), 1.0, 1.0, np.array([0]), np.array([0]), np.array([0])) == pytest.approx(-9000.0 + math.log(3 / 6))


def test_pairs_of_texts_are_found_with_their_places():
    seqs = [np.array(s, np.uint32) for s in ([0, 1, 0, 1, 2], [1], [0, 1, 2])]
    found = lm.Pairs(seqs, lm.unit_hashes([b"a ", b"b ", b"c  "]))
    want = [(-1, 0), (0, 1), (1, 0), (0, 1), (1, 2), (-1, 1), (-1, 0), (0, 1), (1, 2)]
    assert [(int(found.before[k]), int(found.now[k])) for k in found.of] == want
    counts = found.counts(2, np.array([0, -1, 1]))
    assert {(int(a), int(u)): tuple(c) for a, u, c in zip(found.before, found.now, counts.T.tolist())} == {(-1, 0): (1, 1), (0, 1): (2, 1), (1, 0): (1, 0), (1, 2): (1, 1), (-1, 1): (0, 0)}
    parts = list(found.slices(1000))
    assert [a for _, a, _ in parts] + [len(found.codes)] == [0] + [b for *_, b in parts] and sorted({k for k, *_ in parts}) == [k for k, *_ in parts]


def test_empty_table_has_no_pairs(spark):
    assert lm.score_texts(documents(spark, []), lm.held_out(), pairs=True).count() == 0
