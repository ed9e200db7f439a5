"""Ids against the tiktoken library, bytes against the texts."""

import public_tokenizers as P
import pytest
import tiktoken

from pitchside.llm import byte_bpe

from .helpers import documents, rows


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path(byte_bpe.DEFAULT_RANKS))


def test_encode_and_decode(spark, ranks):
    data = rows() + [(200 + i, t, *([None] * 10)) for i, t in enumerate(["<|endoftext|>", "日本語 のテキスト", "🙂🙂 a'll b'S", "\x00\x01 nul", "  lead", "trail  ", "\n\n\n", "a" * 5000])]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(ranks), special_tokens={})
    for limit in (byte_bpe.BLOCK_CHARS, 500):
        encoded = byte_bpe.encode(documents(spark, data), ranks, P.PATTERN, limit=limit)
        got = byte_bpe.decode(encoded, ranks).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
        want = sorted(((d[0], library.encode_ordinary(d[1] or ""), (d[1] or "").encode()) for d in data), key=key)
        assert sorted(((g.doc_id, g.ids, bytes(g.decoded)) for g in got), key=key) == want


def test_empty_table(spark, ranks):
    assert byte_bpe.decode(byte_bpe.encode(documents(spark, []), ranks, P.PATTERN), ranks).count() == 0


def test_unknown_ids_decode_to_nothing(spark, ranks):
    df = spark.createDataFrame([(1, [-5, 10**9, None]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(df, ranks).orderBy("doc_id").collect()] == [b"", b"", b""]
