"""Blocks: bounded runs of documents that share one local vocabulary.

An operator that needs a value for every word of every text (its token ids, its corpus
frequency) would shuffle one row per word occurrence. Instead each task cuts its documents
into blocks of bounded size, numbers the distinct words of a block, and writes

* one row per document: ``(block, id, seq)``, the document as packed word numbers,
* some rows per block: ``(block, slice, words, ...)``, the distinct words of one hash slice.

Only a block's distinct words are shuffled, packed by slice, so even the most frequent word
travels once per block. All blocks' rows of a slice meet in one task, which streams over them
and finds each distinct word's value once; the values return packed, by block, and meet the
documents there. The table is written to the shared folder: block numbers are then fixed,
whatever is recomputed later. A block closes after ``limit`` characters, so it holds at most
that and one document more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a block closes.
BLOCK_CHARS = 32_000_000
#: Hash slices of the words; more of them bound the distinct words that one task meets at a time.
SLICES = 512
#: Tasks among which the slices are dealt; their rows are small and their work is not, so they are not to be merged by size.
SLICE_TASKS = 64


class Numbering(dict):
    """Numbers keys in the order in which they first occur."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def pack(numbers: np.ndarray, width: int = 4) -> bytes:
    """Non-negative numbers of ``width`` bytes, by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers, dtype=f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes, width: int = 4) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts over the whole corpus may pass 32 bits; the upper planes of the others take next to nothing."""
    return pack(counts, 8)


def unpack_counts(packed: bytes) -> np.ndarray:
    return unpack(packed, 8).astype(np.int64)


def block_id(number: int) -> int:
    """A block's id: the task's partition, and the block's number in it."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + number


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(packed: bytes) -> list[bytes]:
    n = 4 + int.from_bytes(packed[:4], "little")
    ends = np.cumsum(unpack(packed[4:n])).tolist()
    text = zstandard.ZstdDecompressor().decompress(packed[n:])
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def slice_parts(keys: list[bytes], slices: int = SLICES) -> Iterator[tuple[int, np.ndarray]]:
    """Each hash slice that has some of the keys, with their places."""
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)) % np.uint64(slices)
    order = np.argsort(of, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(part):
            yield int(of[part[0]]), part


def reassemble(blocks: DataFrame, values: DataFrame, rebuild: Callable, schema) -> DataFrame:
    """``rebuild(documents, values)`` on the Arrow tables of each block; ``values`` has a block column and what was found."""
    docs = blocks.where("slice is null").drop("slice", "words", "numbers", "counts")
    docs = docs.select(*[F.col(c).alias(c) for c in docs.columns])  # columns of its own: both sides come from one table
    return docs.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(rebuild, schema)
