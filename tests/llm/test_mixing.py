"""Targets by repeated filling, copies by their bounds, and the SQL."""

import duckdb

from pitchside.llm import mixing

from .helpers import ascii_words, documents, rows


def targets(data):
    sizes = {}
    for d in data:
        sizes[d[3]] = sizes.get(d[3], 0) + len(ascii_words(d[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}, sizes
        capped.update({s: 3.0 * sizes[s] for s in over})


def test_targets_and_copies(spark):
    data = rows() + [(500 + i, "few words", None, f"s{i}", *([None] * 8)) for i in range(7)]
    got = mixing.mix(documents(spark, data))
    assert got.columns[:3] == ["doc_id", "text", "lang"]
    got = got.collect()
    want, sizes = targets(data)
    assert len(got) == len(data)
    taken = {}
    for g in got:
        assert g["size"] == len(ascii_words(g.text)) and g.source_size == sizes[g.source]
        assert abs(g.target - want[g.source]) < 1e-6 * max(1, want[g.source])
        ratio = g.target / g.source_size if g.source_size else 0
        assert ratio // 1 <= g.copies + 1e-9 and g.copies <= 3 and g.copies <= ratio + 1
        taken[g.source] = taken.get(g.source, 0) + g.copies * g["size"]
    again = mixing.mix(documents(spark, data)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    longest = max(g["size"] for g in got)
    assert all(abs(taken[s] - want[s]) <= 2 * longest for s in want)


def test_taken_documents_and_sql(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs)
    out = mixing.taken_documents(mixed, docs.columns)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed.collect())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(mixing.OP7_SQL).fetchall()
    got = [(r.doc_id, r["size"], r.source_size, r.target, r.copies * r["size"]) for r in mixed.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_table_and_no_words(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    none = mixing.mix(documents(spark, [(1, None, None, "a", *([None] * 8)), (2, "", None, "b", *([None] * 8))])).collect()
    assert [(r["size"], r.target, r.copies) for r in none] == [(0, 0.0, 0)] * 2
