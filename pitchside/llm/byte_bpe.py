"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Texts are cut into pre-tokens by the tokenizer's pattern, kept with their positions as block
sequences (``blocks``). The distinct words of all blocks meet in one shuffle, each is merged
once, its ids go back to its blocks, and documents are reassembled by position.
Decoding joins the token-byte table (as large as the vocabulary, never as the data) to the ids.

Edge cases: null text is an empty text and has no ids; a text may be one pre-token of any
length; strings of special tokens are ordinary text; equal or null ids of documents are
separate rows; ids outside the vocabulary and null ids decode to nothing; an empty table
gives an empty result; other input columns are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_CHARS, SLICE_TASKS, Numbering, block_id, pack, pack_words, slice_parts, unpack, unpack_words
from .common import table, written

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct words whose ids a task keeps; beyond it they are found anew, so memory stays bounded.
MOST_KNOWN = 2_000_000
#: Tokens, about, that are packed together.
PACKED_TOKENS = 200_000


def read_ranks(path: str) -> bytes:
    """A rank file's bytes: lines of base64 token and rank. Read on the driver, sent to tasks as it is."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


_ENCODERS: dict = {}


def _encoder(data: bytes):
    """Merges one piece by the ranks; the pattern takes the whole piece, for it is a pre-token already."""
    import tiktoken

    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=parse_ranks(data), special_tokens={})
    return _ENCODERS[key]


def pretoken_blocks(docs: DataFrame, pattern: str, id_col: str, text_col: str, limit: int = BLOCK_CHARS) -> DataFrame:
    """Block rows of the documents' pre-tokens (see ``blocks``), as small as they get.

    Words are numbered by frequency, and texts packed some at a time. Word rows hold the words of a
    slice (words that begin alike) sorted; ``order`` has the numbers of a block's words in the order
    of its word rows, and stays with the texts.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.BinaryType()),
                           T.StructField("seq", T.BinaryType()), T.StructField("order", T.BinaryType()), T.StructField("slice", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        pieces = regex.compile(pattern).findall
        number, chars, words, ids, seqs = 0, 0, Numbering(), [], []

        def rows(n: int, **columns) -> pa.RecordBatch:
            columns["block"] = [block_id(number)] * n
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)

        def close() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([np.empty(0, np.uint32), *seqs])
            ranks = np.empty(len(words), np.uint32)
            ranks[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.uint32)
            lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
            ends = np.cumsum(lengths)
            part = (ends - lengths) // PACKED_TOKENS
            for p in np.unique(part):
                a, b = np.searchsorted(part, [p, p + 1])
                yield rows(1, ids=[ids[a:b]], lengths=[pack(lengths[a:b])], seq=[pack(ranks[flat[ends[a] - lengths[a]:ends[b - 1]]])])
            listed = [w.encode() for w in words]
            at, packed, order = [], [], [np.empty(0, np.uint32)]
            for k, of in slice_parts([w[:4] for w in listed]):
                of = sorted(of.tolist(), key=listed.__getitem__)
                at.append(k)
                packed.append(pack_words([listed[i] for i in of]))
                order.append(ranks[of])
            yield rows(1, order=[pack(np.concatenate(order))])
            yield rows(len(at), slice=at, words=packed)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = pieces(text or "")
                seqs.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                ids.append(key)
                chars += len(text or "")
                if chars >= limit:
                    yield from close()
                    number, chars, words, ids, seqs = number + 1, 0, Numbering(), [], []
                    pa.default_memory_pool().release_unused()
        if ids:
            yield from close()

    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema), "bpe-blocks")


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK_CHARS) -> DataFrame:
    """``(id_col, ids)``: one row per document, its token ids in order."""
    blocks = pretoken_blocks(docs, pattern, id_col, text_col, limit)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = _encoder(shared.value).encode_ordinary
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            lengths, ids = [], []
            for part, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != now or len(known) > MOST_KNOWN:
                    known, now = {}, part
                lists = []
                for w in unpack_words(words):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = encode_one(w.decode())
                    lists.append(found)
                lengths.append(pack(np.fromiter(map(len, lists), np.uint32, len(lists))))
                ids.append(pack(np.fromiter(chain.from_iterable(lists), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], names=["block", "slice", "n", "found"])

    word_rows = blocks.where("slice is not null").select("slice", "block", "words").repartition(SLICE_TASKS, "slice").sortWithinPartitions("slice", "block")
    values = word_rows.mapInArrow(merge, "block long, slice int, n binary, found binary")
    texts = blocks.where("slice is null").select(*[F.col(c).alias(c) for c in ("block", "ids", "lengths", "seq", "order")])
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def rebuild(rows: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("slice")
        joined = lambda name, kind: np.concatenate([np.empty(0, kind), *(unpack(x).astype(kind) for x in words.column(name).to_pylist())])
        n, flat = joined("n", np.int64), joined("found", np.int32)
        order = next(unpack(x) for x in rows.column("order").to_pylist() if x is not None)
        sizes, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        sizes[order], starts[order] = n, np.cumsum(n) - n
        schema = pa.schema([(id_col, rows.schema.field("ids").type.value_type), ("ids", pa.list_(pa.int32()))])
        batches = []
        # One batch per packed row, so that neither side of the pipe holds a block's ids at once.
        for ids, lengths, packed in zip(rows.column("ids"), rows.column("lengths"), rows.column("seq"), strict=True):
            if not ids.is_valid:
                continue
            seq = unpack(packed.as_py())
            took = sizes[seq]
            ends = np.cumsum(took)
            found = flat[np.repeat(starts[seq] - (ends - took), took) + np.arange(ends[-1] if len(ends) else 0)]
            upto = np.concatenate([[0], ends])[np.cumsum(unpack(lengths.as_py()).astype(np.int64))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(found, pa.int32()))
            batches.append(pa.RecordBatch.from_arrays([ids.values, lists], schema=schema))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(batches, schema=schema)

    return texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(rebuild, T.StructType(fields))


def decode(encoded: DataFrame, ranks: bytes, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` and the bytes its ids stand for, by a map-side join with the token-byte table."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    keep = [c for c in encoded.columns if c != into]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(into, T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parse_ranks(shared.value)
        token_bytes = np.full(max(known.values(), default=-1) + 2, b"", dtype=object)  # the last stands for what is not a token
        for t, i in known.items():
            token_bytes[i] = t
        for batch in batches:
            # Few rows at a time: their ids and bytes are far larger than the rows.
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                decoded = []
                for ids in part.column(keep.index(ids_col)):
                    ids = np.empty(0, np.int64) if not ids.is_valid else pc.fill_null(ids.values, -1).to_numpy(zero_copy_only=False)
                    ids = np.where((ids >= 0) & (ids < len(token_bytes) - 1), ids, len(token_bytes) - 1)
                    decoded.append(b"".join(token_bytes[ids].tolist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*keep, into])

    return encoded.select(*keep).mapInArrow(join, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path(DEFAULT_RANKS))
    both = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
