"""The manifest against a plain Merkle tree on small tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pitchside.llm import merkle

from .helpers import SCHEMA, documents


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, at):
    """Of each level the sibling, if any, and whether it stands to the left."""
    for level in tree[:-1]:
        other = at ^ 1
        yield (level[other] if other < len(level) else None), at % 2
        at //= 2


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    by_lang = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        by_lang.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, own), doc_id, own, leaf(doc_id, source, lang, n_chars + 1, text) if tampered else own))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[0])
        trees[lang] = levels([x[2] for x in by_lang[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, (_, doc_id, own, claimed) in enumerate(by_lang[lang]):
            proof, folded = [], claimed
            for sibling, left in [*path(trees[lang], at), *path(top, k)]:
                proof += [sibling] if sibling else []
                folded = digest(folded) if sibling is None else digest(sibling, folded) if left else digest(folded, sibling)
            out.append((doc_id, own, trees[lang][-1][0], top[-1][0], digest(*proof), folded, folded == top[-1][0]))
    return out


@pytest.fixture
def table_of(tmp_path):
    def write(df):
        df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def awkward(spark, langs=None):
    df = documents(spark)
    return df.withColumn("lang", F.when(F.col("doc_id") % 11 == 4, "solo").when(F.col("doc_id") % 5 == 1, "-").otherwise(F.col("lang")))


def test_awkward_rows_with_many_hops(spark, table_of, monkeypatch):
    # Hops of two levels and nothing broadcast: every path of the code on a small table.
    monkeypatch.setattr(merkle, "HOP", 2)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    df = awkward(spark)
    got = merkle.op12_merkle_manifest(spark, table_of(df))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute([tuple(r) for r in df.collect()])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert {w[-1] for w in want} == {True, False}


def test_sql_agrees_and_equal_rows(spark, table_of):
    df = awkward(spark)
    df = df.union(df.where("doc_id in (7, 100)"))
    path_of = table_of(df)
    got = Counter(map(tuple, merkle.op12_merkle_manifest(spark, path_of).collect()))
    assert got == Counter(brute([tuple(r) for r in df.collect()]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path_of}/documents.parquet/*.parquet'")
    assert got == Counter(con.execute(merkle.OP12_SQL).fetchall())


def test_proofs_stand_alone(spark):
    """Siblings and root suffice to verify a leaf; claims of a field are refused."""
    df = documents(spark)
    held = merkle.manifest(df, {"text": F.when(F.col("doc_id") == 5, F.lit("forged")).otherwise(F.col("text"))})
    rows = merkle.verified(held).collect()
    assert [r.id for r in rows if not r.verified] == [5] and {r.root for r in rows} == {held.root}
    # Every stored row is linked to a stored node or to the root.
    parents = ["parent_tree", "parent_level", "parent_place"]
    nodes = held.nodes.select("tree", "level", "place", *parents).collect()
    there = {tuple(n)[:3] for n in nodes} | {(merkle.TOP, held.height, 0)}
    assert {tuple(n)[3:] for n in nodes} | {tuple(n) for n in held.leaves.select(*parents).collect()} <= there


def test_few_rows(spark):
    one = spark.createDataFrame([(1, "a b", "en", None, None, *["x"] * 7)], SCHEMA)
    got = merkle.verified(merkle.manifest(one)).first()
    assert got.leaf == got.subroot == got.root == got.folded_root == leaf(1, None, "en", None, "a b") and got.verified and got.siblings == []
    assert merkle.verified(merkle.manifest(one.limit(0))).count() == 0
