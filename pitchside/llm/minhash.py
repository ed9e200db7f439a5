"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets
share one node, named by a 128-bit digest of the set, so exact copies never meet each other.
One hash of every shingle fills the bins of a signature; an empty bin copies the bin that a
fixed probe sequence, the same for all documents, reaches first (optimal densification).
Bands of the signature are the buckets.

Candidates of a bucket form a star around one centre, so their number is the bucket's size:

1. the centre is the smallest node; candidates are confirmed on the full sets;
2. where the members of a bucket do not share one best linked neighbour (hub), the member with the
   most confirmed links so far (the text that many near copies come from, if it is there) is a
   second centre;
3. what is then still apart in a bucket is compared exactly, in blocks of bounded size: a pair
   is looked at in the first bucket that it shares, set aside if its signatures agree in far
   too few bins, and otherwise confirmed on the full sets within the task. Only links leave it.

So no link that two documents of one bucket have is lost to the stars, and no step emits all
pairs of a group. Bands follow the threshold (``bands_for``): with 28 bands of 6 bins two documents at
similarity 0.85 share no bucket with a probability of 2e-6, and so do two at 0.8 with 34 bands of 5.

Edge cases: null or empty text, or text without words, has an empty set, links with nothing and
is its own component; a text shorter than a shingle is one shingle; rows with a null id take part,
but a component is named by its smallest id that is not null; repeated rows are copies; an empty
table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written
from .components import connected_components

SHINGLE = 5
#: Probability with which a pair at the threshold may share no bucket, and the most bins of a signature (unless bands of one need more).
MISS, MOST_BINS = 2e-6, 170
#: Standard deviations below the threshold at which a pair's share of agreeing bins is too small to confirm it.
DEVIATIONS = 5.1
#: Bytes of shingle sets in one block of step 3.
BLOCK_BYTES = 1_000_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the frequent ones: emptied when it grows past a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (A-Z lower-cased, words between ASCII white space)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * _MIX[0] + w[j:j + n]
    return np.unique(_scramble(h))


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, bins of a band) for a threshold: the longest bands with which pairs at it are missed no more often than ``MISS``."""
    alike = min(percent, 99) / 100
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-alike ** rows))
        if bands * rows <= MOST_BINS or rows == 1:
            return bands, rows
    raise AssertionError


def least_agreement(percent: int) -> float:
    """Share of agreeing bins below which a pair is not confirmed."""
    bands, rows = bands_for(percent)
    alike = percent / 100
    return alike - DEVIATIONS * math.sqrt(alike * (1 - alike) / (bands * rows))


_PROBES: dict[int, list[np.ndarray]] = {}


def _probe(step: int, n_bins: int) -> np.ndarray:
    """The bin that each empty bin looks at in its ``step``-th attempt."""
    probes = _PROBES.setdefault(n_bins, [])
    while len(probes) <= step:
        seed = np.arange(n_bins, dtype=np.uint64) * _MIX[0] + np.uint64((len(probes) + 1) * int(_MIX[1]) % 2**64)
        probes.append((_scramble(seed) % np.uint64(n_bins)).astype(np.int64))
    return probes[step]


def signature(shingles: np.ndarray, n_bins: int) -> np.ndarray:
    """One value per bin; of a non-empty sorted set."""
    # Bins are ranges of the hash, so a bin's minimum is the first of its run in the sorted set.
    bins = ((shingles >> np.uint64(32)) * np.uint64(n_bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    own = np.zeros(n_bins, np.uint64)
    full = np.zeros(n_bins, bool)
    own[bins[first]], full[bins[first]] = shingles[first], True
    out, empty, step = own.copy(), np.flatnonzero(~full), 0
    while len(empty):
        at = _probe(step, n_bins)[empty]
        hit = full[at]
        out[empty[hit]] = own[at[hit]]
        empty, step = empty[~hit], step + 1
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        h = _scramble(h * _MIX[0] + parts[:, j])
    return h.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    n_bands, n_rows = bands_for(percent)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, hashes, width)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                bands.append(band_hashes(signature(s, n_bands * n_rows), n_bands, n_rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sketch, schema), "minhash-sketches")


def _full_sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``(key, shingles, signature)`` of the nodes in ``chosen (id, key)``, from their texts."""
    schema = "key binary, shingles array<bigint>, signature binary"
    n_bins = math.prod(bands_for(percent))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, found, sigs = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, hashes, width)
                if len(s) and set_key(s) == key:  # an id may stand on rows with different texts
                    keys.append(key)
                    found.append(s.view(np.int64))
                    sigs.append(signature(s, n_bins).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["key", "shingles", "signature"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.col("id").eqNullSafe(F.col("of"))).select("key", "text")
    return written(texts.mapInArrow(sets, schema).dropDuplicates(["key"]), "minhash-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    one = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    inter = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(one, "b").join(two, "a").select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def _hubs(links: DataFrame) -> DataFrame:
    """``(key, degree, hub)``: each linked node's number of links, and the best linked among itself and its neighbours.

    Nodes with one hub are in one component. Nodes of one component may have several hubs; they
    are then compared once more than needed, and none is missed.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = written(both.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("degree")), "minhash-degrees")
    reached = both.join(degrees.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"), F.struct("degree", F.col("b").alias("hub")).alias("h"))
    own = degrees.select("key", F.struct("degree", F.col("key").alias("hub")).alias("h"))
    best = reached.union(own).groupBy("key").agg(F.max("h").alias("h"))
    return best.join(degrees, "key").select("key", "degree", F.col("h.hub").alias("hub"))


def _apart(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Members of the buckets whose members do not all have one hub, with hub and degree."""
    placed = written(members.join(hubs, "key", "left").select(
        "bucket", "key", F.coalesce("hub", "key").alias("hub"), F.coalesce("degree", F.lit(0)).alias("degree")), "minhash-placed")
    # The best linked member is the bucket's next centre.
    mixed = written(placed.groupBy("bucket").agg(F.min("hub").alias("lo"), F.max("hub").alias("hi"), F.max(F.struct("degree", "key", "hub")).alias("c")).where(
        "lo <> hi").select("bucket", F.col("c.key").alias("centre"), F.col("c.hub").alias("centre_hub")), "minhash-mixed")
    return placed.select("bucket", "key", "hub").join(mixed, "bucket")


def _compare_blocks(apart: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that have different hubs, all pairs looked at in blocks."""
    least = least_agreement(percent)
    bands = sketches.where("key is not null").groupBy("key").agg(F.first("bands").alias("bands"))
    full = apart.join(sets, "key")
    sized = written(full.groupBy("bucket").agg(F.ceil(F.sum(F.size("shingles") * 8 + 1000) / BLOCK_BYTES).cast("int").alias("blocks")), "minhash-sizes")
    rows = full.join(bands, "key").join(sized, "bucket").select(
        "bucket", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "hub", "signature", "shingles", "bands")
    packed = written(rows.groupBy("bucket", "blocks", "block").agg(F.collect_list(F.struct("key", "hub", "signature", "shingles", "bands")).alias("rows")), "minhash-blocks")
    left = packed.select("bucket", F.col("block").alias("i"), F.col("rows").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = packed.select("bucket", F.col("block").alias("j"), F.col("rows").alias("y"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))

    def links(key, xs: pa.Table, ys: pa.Table) -> pa.Table:
        if not xs.num_rows or not ys.num_rows:  # members fall into blocks by hash: some stay empty
            return pa.table([pa.array([], pa.binary()), pa.array([], pa.binary())], names=["a", "b"])
        bucket, i, j = (v.as_py() for v in key)
        x, y = xs.column("x").to_pylist()[0], ys.column("y").to_pylist()[0]
        cols = lambda rows, c, t: np.array([np.frombuffer(r[c], t) if isinstance(r[c], bytes) else r[c] for r in rows])
        ysig, yband, yhub = cols(y, "signature", "<u2"), cols(y, "bands", np.int64), np.array([r["hub"] for r in y], dtype=object)
        ysets = [np.array(r["shingles"], np.int64) for r in y]
        a, b = [], []
        for p, row in enumerate(x):
            same = yband == np.array(row["bands"], np.int64)
            shared = same.any(axis=1)
            near = (ysig == np.frombuffer(row["signature"], "<u2")).mean(axis=1) >= least
            here = yband[np.arange(len(y)), same.argmax(axis=1)] == bucket
            look = np.flatnonzero(near & shared & here & (yhub != row["hub"]) & ((np.arange(len(y)) > p) | (i != j)))
            if len(look):
                sx = np.array(row["shingles"], np.int64)
                for q in look:
                    n = len(np.intersect1d(sx, ysets[q], assume_unique=True))
                    if 100 * n >= percent * (len(sx) + len(ysets[q]) - n):
                        a.append(row["key"])
                        b.append(y[q]["key"])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    by = ["bucket", "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(links, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of its component) and kept (it is that document)."""
    sketches = _sketches(docs, id_col, text_col, width, percent)
    exploded = sketches.where("key is not null").select(F.explode("bands").alias("bucket"), "key")
    # Buckets with two different nodes; the smallest is the first centre.
    stars = written(exploded.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("bucket", "a"), "minhash-stars")
    members = written(exploded.join(stars.select("bucket"), "bucket", "left_semi").distinct(), "minhash-members")
    named = sketches.where("key is not null").groupBy("key").agg(F.min("id").alias("of"))
    chosen = named.join(members.select("key").distinct(), "key", "left_semi")
    sets = _full_sets(docs, chosen, id_col, text_col, width, percent)

    first = members.join(stars, "bucket").where("a <> key").select("a", F.col("key").alias("b")).distinct()
    links = written(_confirmed(first, sets, percent), "minhash-links")
    apart = _apart(members, _hubs(links))
    second = apart.where("hub <> centre_hub").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    links = written(links.union(_confirmed(second, sets, percent)), "minhash-links")
    apart = written(_apart(members, _hubs(links)).select("bucket", "key", "hub"), "minhash-apart")

    links = links.union(_compare_blocks(apart, sets, sketches, percent))
    parts = written(connected_components(links), "minhash-parts")

    placed = sketches.join(parts.withColumnRenamed("node", "key"), "key", "left").select(
        "id", "n_shingles", F.coalesce("component", "key").alias("part"))
    smallest = written(placed.where("part is not null").groupBy("part").agg(F.min("id").alias("component_id")), "minhash-smallest")
    out = placed.join(smallest, "part", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
