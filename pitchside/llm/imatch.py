"""Document fingerprints by I-Match: hashes of a text's terms under randomised lexicons.

Terms are words between ASCII white space, A-Z lower-cased. The lexicon keeps the terms within a
band of document frequency, ``[LEAST, MOST]`` as shares of all documents: frequent words say
nothing, and rare ones are errors or names. Document frequencies are counted over all documents;
tasks pre-count, and packed counts are shuffled. The lexicon can hold no more than (distinct terms
per document) / LEAST terms, however large the corpus, so it is sent to every task. Terms are counted
in slices by their hash, whose number follows the square root of the number of documents.

A fingerprint has one hash for each of ``SUBSETS`` random parts of the lexicon: the distinct terms
of the text that the part keeps, sorted, hashed together. Parts keep from an eighth down to a
1024th of the lexicon, so that short texts and long ones have parts with a few terms, which survive
an edit elsewhere in the text. The likeness of two fingerprints is the share of equal hashes among
the parts in which either text has terms. If no part keeps any term of a text (it has very few), its
first hash is that of all its terms.

Neighbours: documents are sorted by descending id over range partitions; a task meets a document
and the next one in one pass, and only the first and last documents of the partitions are matched
afterwards.

Edge cases: null text is empty; a text with fewer than ``FEWEST`` lexicon terms is fingerprinted by
all its terms, and one without words has an empty fingerprint, whose likeness is 1 to an equal
text and 0 to others; null ids come last; rows of one id are ordered by a digest of their text; a
single document is its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack_counts, unpack_counts
from .common import table, written

#: Document-frequency band of the lexicon, as shares of all documents.
LEAST, MOST = 1 / 2000, 1 / 5
#: Levels of keep rates 1/8, 1/16, ... and random parts of each.
LEVELS, PER_LEVEL = 8, 8
SUBSETS = LEVELS * PER_LEVEL
FEWEST = 8
#: log2 of the slices among which the distinct terms of a small corpus are counted.
SLICE_BITS = 8

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEEDS = np.arange(1, SUBSETS + 1, dtype=np.uint64) * _MIX[0]
_LIMITS = np.array([np.uint64(2**64 >> (3 + k // PER_LEVEL)) for k in range(SUBSETS)], np.uint64)


class TermHashes(dict):
    """64-bit hashes of terms; emptied when it grows past a bound."""

    def __missing__(self, term: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 500_000:
            self.clear()
        h = self[term] = xxh3_64_intdigest(term)
        return h


def terms_of(text: str, hashes: TermHashes) -> np.ndarray:
    """Sorted distinct term hashes."""
    words = set(text.encode().lower().split())
    out = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out.sort()
    return out


def slice_bits(documents: int) -> int:
    """log2 of the slices: as many as the square root of the documents, since distinct terms grow more slowly than the corpus."""
    return max(SLICE_BITS, -(-int(documents).bit_length() // 2))


def document_frequencies(docs: DataFrame, text_col: str = "text", flush: int = 2_000_000, bits: int = SLICE_BITS) -> DataFrame:
    """``(slice, terms, counts)``: packed sorted term hashes and their document counts, each term in one row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = TermHashes(), Counter()

        def out() -> pa.RecordBatch:
            terms = np.fromiter(seen.keys(), np.uint64, len(seen))
            counts = np.fromiter(seen.values(), np.int64, len(seen))
            order = np.argsort(terms)
            terms, counts = terms[order], counts[order]
            of = (terms >> np.uint64(64 - bits)).astype(np.int64)  # the slice: the first bits of the hash
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            ends = [*starts[1:], len(of)]
            rows = [(int(of[a]), _pack_terms(terms[a:b]), pack_counts(counts[a:b])) for a, b in zip(starts, ends, strict=False)]
            part, t, c = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(t, pa.binary()), pa.array(c, pa.binary())], names=["slice", "terms", "counts"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(terms_of(text or "", hashes).tolist())
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, terms, counts = None, [], []

        def out() -> pa.RecordBatch:
            t, inverse = np.unique(np.concatenate(terms), return_inverse=True)
            c = np.zeros(len(t), np.int64)
            np.add.at(c, inverse, np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack_terms(t)], pa.binary()), pa.array([pack_counts(c)], pa.binary())], names=["slice", "terms", "counts"])

        for batch in batches:
            for part, t, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part != now and terms:
                    yield out()
                    terms, counts = [], []
                now = part
                terms.append(_unpack_terms(t))
                counts.append(unpack_counts(c))
        if terms:
            yield out()

    schema = "slice int, terms binary, counts binary"
    packed = docs.select(text_col).mapInArrow(count, schema)
    return packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, schema)


def _pack_terms(sorted_terms: np.ndarray) -> bytes:
    """Sorted hashes of one slice as compressed differences: six bytes and some for each."""
    import zstandard

    steps = np.diff(sorted_terms, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack_terms(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted hashes of the terms within the band; at least two documents must have a term."""
    n = docs.count()
    low, high = max(2.0, least * n), max(2.0, most * n)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                c = unpack_counts(c)
                kept.append(_unpack_terms(t)[(c >= low) & (c <= high)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], names=["terms"])

    rows = document_frequencies(docs, text_col, bits=slice_bits(n)).mapInArrow(band, "terms binary").collect()
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["terms"], np.uint64) for r in rows)]))


def fingerprint(terms: np.ndarray, lexicon_terms: np.ndarray) -> list[str]:
    """One hash per random part of the lexicon; empty where the part keeps none of the terms, but never in all parts if there is a term."""
    from xxhash import xxh3_64_hexdigest

    if len(lexicon_terms):
        at = np.minimum(np.searchsorted(lexicon_terms, terms), len(lexicon_terms) - 1)
        inside = terms[lexicon_terms[at] == terms]
        if len(inside) >= FEWEST:
            terms = inside
    x = terms[None, :] ^ _SEEDS[:, None]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    kept = (x ^ (x >> np.uint64(31))) < _LIMITS[:, None]
    some = kept.any(axis=1)
    if len(terms) and not some.any():
        kept[0] = some[0] = True
    return [xxh3_64_hexdigest(terms[kept[k]].tobytes())[:8] if some[k] else "" for k in range(SUBSETS)]


def likeness(a: list[str], b: list[str], equal: bool) -> float:
    held = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in held) / len(held) if held else float(equal)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the first as many code points of the following one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likenesses to the edited and the next text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs, text_col, least, most))
    id_type = docs.schema[id_col].dataType
    fields = T._parse_datatype_string(_FIELDS).fields
    out_schema = T.StructType([T.StructField("id", id_type), *fields])
    # part and end: 0 a complete row, 1 and 2 the first and the last document of a partition, which go on with their text.
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("end", T.IntegerType()), *out_schema.fields, T.StructField("text", T.StringType())])

    def finished(text, prints, following, next_prints, hashes) -> tuple:
        new = edited(text, following)
        new_prints = prints if new == text else fingerprint(terms_of(new, hashes), shared.value)
        return (len(text), hashlib.sha256(new.encode()).hexdigest(), ".".join(prints), ".".join(new_prints),
                likeness(prints, new_prints, new == text), likeness(prints, next_prints, text == following))

    def batch_of(rows: list[tuple], to: T.StructType) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(to)
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        import zstandard

        unpacked = zstandard.ZstdDecompressor().decompress
        part, hashes, last = TaskContext.get().partitionId(), TermHashes(), None
        none = (None,) * len(fields)
        for batch in batches:
            rows = []
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = unpacked(packed).decode()
                prints = fingerprint(terms_of(text, hashes), shared.value)
                if last is None:
                    rows.append((part, 1, key, *none, text))
                else:
                    rows.append((part, 0, last[0], *finished(last[1], last[2], text, prints, hashes), None))
                last = (key, text, prints)
            yield batch_of(rows, schema)
        if last is not None:
            yield batch_of([(part, 2, last[0], *none, last[1])], schema)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeezer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [squeezer.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "packed"])

    # Texts are dealt out by id once, compressed: that shuffle is most of what the job writes.
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        squeeze, T.StructType([T.StructField("id", id_type), T.StructField("packed", T.BinaryType())]))
    order = [F.col("id").desc_nulls_last()]
    walked = written(given.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64("packed")).mapInArrow(walk, schema), "imatch-walked")

    # One pair of rows per partition: the last document of each with the first of the next, the very last with the very first.
    firsts = walked.where("end = 1").select("part")
    around = Window.orderBy("part")
    links = firsts.select("part", F.coalesce(F.lead("part").over(around), F.min("part").over(Window.partitionBy())).alias("next"))
    tails = walked.where("end = 2").select("part", "id", F.col("text").alias("text")).join(links, "part")
    heads = walked.where("end = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for batch in batches:
            rows = []
            for key, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                prints, others = (fingerprint(terms_of(t, hashes), shared.value) for t in (text, following))
                rows.append((key, *finished(text, prints, following, others, hashes)))
            yield batch_of(rows, out_schema)

    ends = tails.join(heads, "next").select("id", "text", "following").mapInArrow(join_ends, out_schema)
    every = walked.where("end = 0").select(*out_schema.names).union(ends)
    return every.select(F.col("id").alias(id_col), *out_schema.names[1:])


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
