"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text, A-Z lower-cased, is a sequence of units: a word and the white-space byte after it, or the
end of the text. The symbols of a unit (256 bytes and the end) are coded bit by bit along a Huffman
tree, so the probability of a text is a product of bit probabilities. Each bit is predicted from
several hashed contexts within its unit (its last 1 to 5 bytes, all of them, and these per group of
documents) by the counts of zeros and ones that followed them in the training texts. The
predictions are mixed in the logistic domain, with weights that a gate selects by how often the
longest contexts were seen; the weights are learnt online, each unit's own occurrence taken out of
its counts, by every task over its part of the vocabulary, and averaged after each round (so they, and the
scores, may differ slightly between runs that divide the units otherwise).

There is one expert per frequent value of the grouping column (language, say), which only the
training looks at. A document's score mixes the experts, refined adaptively as the text goes on:
each unit moves weight to the experts that predicted it, which multiplies out to the logarithm of
the experts' mean probability of the whole text.

The bit predictors say how a unit is spelt; how often each whole unit occurs in an expert's training
texts is counted exactly, in rows that grow with the corpus, and joined to the units by slice. The
two are combined as ``(count + new * spelt) / (all + new)``, where ``new`` is the expert's number of
units that occur once, plus one: the share of what was met for the first time. So a unit's
probabilities still add up to one, and only units that are rare or new depend on their spelling.

With ``pairs`` the unit before counts too (the start of a text stands before its first one). How often
each unit follows another is counted exactly, per expert, and combined with the unit's own probability
as ``(pairs + kinds * alone) / (before + kinds)``: ``before`` is how often the other one occurs, and
``kinds`` how many different units are expected after it, a power of ``before`` that adds up to the
expert's number of distinct pairs. The power is the share of the pairs that occur once.

The spelling and the count of a unit depend on nothing outside it, so counting, learning and scoring work on
distinct units with their counts. Documents are kept as block sequences (``blocks``); what is
shuffled is each block's distinct units, and its distinct pairs as 64-bit hashes in order, sliced by hash, so that
a frequent unit's pairs are spread over all tasks; both grow with the corpus. The spelling's count tables
have a fixed size, given by ``TABLE_BITS``, and are all that is sent to every task. Counts have 64 bits.

Edge cases: an empty text has no bits per byte (null); null text is empty: one end; without training texts every bit has probability 1/2;
rows without an id are learnt from, and never held out; null groups are the last expert's; repeated
rows count again; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import contextlib
import ctypes
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, scratch_path, shuffles_dropped
from .blocks import BLOCK_CHARS, SLICES, SLICE_TASKS, Numbering, block_id, pack, pack_counts, pack_words, reassemble, slice_parts, unpack, unpack_counts, unpack_words
from .common import table, written

#: log2 of the slots of each predictor's table: contexts of 1, 2, 3, 5 bytes, the whole prefix, and the prefix per group.
TABLE_BITS = (16, 19, 19, 20, 21, 21)
WHOLE, GROUPED = 4, 5
INPUTS = len(TABLE_BITS) + 1
GATES = 32
#: Experts at most; the most frequent groups have one each, the last stands for the others.
EXPERTS = 5
ROUNDS, RATE = 2, 0.4
PRIOR_COUNT = 0.05
END = 256
CHUNK = 1 << 15
_UNITS_AT_ONCE = 20_000
#: Characters of text for each hash slice of the words, so that the distinct units of a slice stay bounded.
SLICE_CHARS = 8_000_000

_SPACE = b" \t\n\x0b\x0c\r"
_UNIT = re.compile(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Stands for the hash of what is before a text's first unit.
_START = np.uint64(0x5851F42D4C957F2D)


def units_of(text: str | None) -> list[bytes]:
    """The units of a text; the last one ends with two spaces, which stand for the end."""
    found = _UNIT.findall((text or "").encode().lower() + b" ")
    found[-1] += b" "
    return found


def word_of(unit: bytes) -> bytes:
    return unit[:-2] if unit[-2:] == b"  " else unit[:-1]


@dataclass(frozen=True)
class Model:
    codes: np.ndarray            # symbol, step -> node * 2 + bit, or -1
    tables: tuple = ()           # per predictor: counts of zeros and ones, slot by slot, as 32-bit floats, whose logarithms count
    weights: np.ndarray | None = None


def packed_model(model: Model) -> Model:
    """The model as it is sent to tasks, once: most slots of a small corpus' tables are empty."""
    return replace(model, tables=tuple(pack(t.reshape(-1).view(np.uint32)) for t in model.tables))


def opened_model(model: Model) -> Model:
    return replace(model, tables=tuple(unpack(t).view(np.float32).reshape(-1, 2) for t in model.tables))


def huffman(counts: np.ndarray) -> np.ndarray:
    """``codes[symbol, step]`` = node * 2 + bit, -1 after the end."""
    heap = [(float(c) + 1.0, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    children, order = {}, len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        children[order] = (x, y)
        heapq.heappush(heap, (a + b, order, order))
        order += 1
    paths: dict[int, list[int]] = {}
    todo = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if node in children:
            todo += [(children[node][bit], [*path, (node - len(counts)) * 2 + bit]) for bit in (0, 1)]
        else:
            paths[node] = path
    codes = np.full((len(counts), max(map(len, paths.values()))), -1, np.int32)
    for symbol, path in paths.items():
        codes[symbol, :len(path)] = path
    return codes


class Bits:
    """The coded bits of some sorted units, what they are, and where each predictor looks them up.

    A unit shares the beginning that it has in common with the one before it: only the symbols
    after it are coded, and ``weights`` and ``totals`` pass counts and costs along the shared ones.
    """

    def __init__(self, units: list[bytes], codes: np.ndarray):
        n = len(units)
        ends = np.array([u[-2:] == b"  " for u in units], bool)
        self.lengths = np.fromiter(map(len, units), np.int64, n) - ends
        data = np.frombuffer(b"".join(u[:-1] if e else u for u, e in zip(units, ends, strict=True)), np.uint8).astype(np.int64)
        stops = np.cumsum(self.lengths)
        starts = stops - self.lengths
        data[stops[ends] - 1] = END
        self.shared = np.zeros(n, np.int64)
        live, depth = np.arange(1, n), 0
        while len(live):
            live = live[(self.lengths[live] > depth) & (self.lengths[live - 1] > depth)]
            live = live[data[starts[live] + depth] == data[starts[live - 1] + depth]]
            depth += 1
            self.shared[live] = depth
        owner = np.repeat(np.arange(n), self.lengths)
        place = np.arange(len(data)) - starts[owner]
        byte = (data + 1).astype(np.uint64)
        # The prefix: a polynomial hash, as a difference of running sums.
        powers = np.cumprod(np.full(int(self.lengths.max()) if n else 1, _MIX[0]), dtype=np.uint64)
        running = np.cumsum(byte * powers[place], dtype=np.uint64) - byte * powers[place]
        new = np.flatnonzero(place >= self.shared[owner])
        first = running[starts[owner[new]]]
        place = place[new]

        def back(k: int) -> np.ndarray:
            return np.where(place >= k, byte[np.maximum(new - k, 0)], np.uint64(0))

        b1, b2, b3 = back(1), back(2), back(3)
        two = b1 | (b2 << np.uint64(9))
        three = two | (b3 << np.uint64(18))
        five = three | (back(4) << np.uint64(27)) | (back(5) << np.uint64(36))
        path = codes[data[new]]
        at, step = np.nonzero(path >= 0)
        coded = path[at, step]
        self.first = step == 0
        self.symbol, self.symbols = at, len(new)  # the coded symbol of each bit, and how many there are
        self.bit = (coded & 1).astype(np.int64)
        self.node = (coded >> 1).astype(np.uint64) * _MIX[2]
        prefix = running[new] - first
        self.contexts = [c[at] * _MIX[0] + self.node for c in (b1, two, three, five, prefix, prefix)]

    def slots(self, k: int, expert: int) -> np.ndarray:
        salt = np.uint64(((k + 1) * 0x9E3779B97F4A7C15 + (expert + 1 if k == GROUPED else 0) * 0xBF58476D1CE4E5B9) % 2**64)
        x = (self.contexts[k] + salt) * _MIX[1]
        return ((x ^ (x >> np.uint64(31))) * _MIX[2] >> np.uint64(64 - TABLE_BITS[k])).astype(np.int64)

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """For each coded symbol the occurrences of all units that share it."""
        out = np.empty(self.symbols, np.int64)
        along = np.zeros(int(self.lengths.max()) if len(self.lengths) else 0, np.int64)
        at, cut = self.symbols, 0
        for length, shared, n in zip(self.lengths[::-1].tolist(), self.shared[::-1].tolist(), counts[::-1].tolist(), strict=True):
            along[cut:] = 0
            along[:length] += n
            out[at - (length - shared):at] = along[shared:length]
            at, cut = at - (length - shared), shared
        return out

    def totals(self, costs: np.ndarray) -> np.ndarray:
        """For each unit the sum over its symbols, shared ones too; ``costs`` has a row per coded symbol and a column per expert."""
        out = np.empty((len(self.lengths), costs.shape[1]))
        along = np.zeros((int(self.lengths.max()) + 1 if len(self.lengths) else 1, costs.shape[1]))
        at = 0
        for u, (length, shared) in enumerate(zip(self.lengths.tolist(), self.shared.tolist(), strict=True)):
            fresh = length - shared
            if fresh:
                along[shared + 1:length + 1] = along[shared] + np.cumsum(costs[at:at + fresh], axis=0)
            at += fresh
            out[u] = along[length]
        return out

    def counted(self, model: Model, expert: int) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and gate of every bit, one occurrence of it taken out of the counts."""
        x = np.empty((len(self.bit), INPUTS), np.float32)
        sign = (2 * self.bit - 1).astype(np.float32)
        seen = {}
        for k, counts in enumerate(model.tables):
            at = self.slots(k, expert) * 2 + self.bit
            flat = counts.reshape(-1)
            same, other = flat.take(at) - np.float32(1), flat.take(at ^ 1)
            np.maximum(same, 0, out=same)
            x[:, k] = sign * np.log((same + PRIOR_COUNT) / (other + PRIOR_COUNT))
            if k in (WHOLE, GROUPED):
                seen[k] = _level(same + other)
        x[:, -1] = 0.3
        return x, seen[WHOLE] * 8 + seen[GROUPED] * 2 + self.first


def _level(n: np.ndarray) -> np.ndarray:
    return (n >= 1).astype(np.int64) + (n >= 4) + (n >= 32)


def stretched(counts: np.ndarray) -> np.ndarray:
    n = counts.astype(np.float32)
    return np.log((n[:, 1] + PRIOR_COUNT) / (n[:, 0] + PRIOR_COUNT))


class Scorer:
    """log10 probabilities of units by every expert."""

    def __init__(self, model: Model, experts: int):
        self.model, self.experts = model, experts
        self.stretched = [stretched(t) for t in model.tables]
        self.levels = {k: _level(model.tables[k].sum(axis=1)).astype(np.uint8) for k in (WHOLE, GROUPED)}

    def log10(self, units: list[bytes]) -> np.ndarray:
        out = np.empty((len(units), self.experts))
        order = sorted(range(len(units)), key=units.__getitem__)
        weights = self.model.weights.astype(np.float32)
        for a in range(0, len(units), _UNITS_AT_ONCE):
            part = order[a:a + _UNITS_AT_ONCE]
            bits = Bits([units[i] for i in part], self.model.codes)
            x = np.empty((len(bits.bit), INPUTS), np.float32)
            x[:, -1] = 0.3
            for k in range(GROUPED):
                at = bits.slots(k, 0)
                x[:, k] = self.stretched[k][at]
                if k == WHOLE:
                    gate = self.levels[k][at].astype(np.int64) * 8 + bits.first
            costs = np.empty((bits.symbols, self.experts))
            sign = (1 - 2 * bits.bit).astype(np.float32)
            for expert in range(self.experts):
                at = bits.slots(GROUPED, expert)
                x[:, GROUPED] = self.stretched[GROUPED][at]
                z = np.einsum("bf,bf->b", x, weights[gate + self.levels[GROUPED][at].astype(np.int64) * 2])
                costs[:, expert] = np.bincount(bits.symbol, weights=np.log1p(np.exp(np.clip(sign * z, -18, 18))), minlength=bits.symbols)
            out[part] = bits.totals(costs) / -np.log(10)
        return out


def with_counts(spelt: np.ndarray, counts: np.ndarray, sizes: np.ndarray, once: np.ndarray) -> np.ndarray:
    """log10 probabilities from those of the spelling and the training counts, a row per unit and a column per expert."""
    with np.errstate(divide="ignore"):
        return (np.logaddexp(np.log(counts), np.log(once + 1) + spelt * np.log(10)) - np.log(sizes + once + 1)) / np.log(10)


def after_another(alone: np.ndarray, occurs: np.ndarray, power: float, scale: float, before: np.ndarray, now: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Natural logarithms of one expert's probabilities of the units ``now`` after the units ``before``, which occur so ``pairs`` often together.

    By unit there are the logarithm of its probability ``alone`` and how often it ``occurs`` before another; the last of ``occurs`` is the start of
    a text, -1 in ``before``. ``scale * occurs ** power`` different units are expected after one.
    """
    kinds = np.where(occurs > 0, scale * occurs.astype(np.float64) ** power, 1.0)
    out = np.exp(alone)[now]
    out *= kinds[before]
    out += pairs
    small = np.flatnonzero(out < 1e-290)  # too long a unit for its probability to be a number
    with np.errstate(divide="ignore"):
        np.log(out, out=out)
    out[small] = alone[now[small]] + np.log(kinds[before[small]])
    out -= np.log(occurs + kinds)[before]
    return out


def _give_back() -> None:
    """Return to the system what this worker has freed, such as an earlier task's tables."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, where they fit."""
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts


def unit_hashes(units: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units))


class Pairs:
    """The distinct neighbours in some texts, in order of their hashes: ``codes``; the units ``before`` (-1 at a start) and ``now``; and, for
    every place in the texts, ``of``: which pair it is. The texts begin at ``starts``."""

    def __init__(self, seqs: list[np.ndarray], hashes: np.ndarray):
        self.lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))  # no text is without a unit
        self.starts = np.cumsum(self.lengths) - self.lengths
        units = np.concatenate([np.empty(0, np.uint32), *seqs])
        own = hashes[units]
        x = np.empty_like(own)
        x[1:] = own[:-1]
        x[self.starts] = _START
        x *= _MIX[0]
        x += own
        x *= _MIX[1]
        np.right_shift(x, np.uint64(31), out=own)
        x ^= own
        x *= _MIX[2]
        del own
        order = np.argsort(x)
        x = x[order]
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        self.codes, first = x[new], order[new]
        del x
        self.of = np.empty(len(new), np.int32)
        self.of[order] = np.cumsum(new, dtype=np.int32) - 1
        begins = np.zeros(len(new), bool)
        begins[self.starts] = True
        self.now, self.before = units[first], units[first - 1].astype(np.int32)
        self.before[begins[first]] = -1

    def counts(self, experts: int, of_text: np.ndarray) -> np.ndarray:
        """How often each expert's texts hold each pair; ``of_text`` has a text's expert, or -1."""
        expert = np.repeat(of_text, self.lengths)
        return np.stack([np.bincount(self.of[expert == e], minlength=len(self.codes)).astype(np.uint32) for e in range(experts)])

    def slices(self, slices: int) -> Iterator[tuple[int, int, int]]:
        """Each hash slice that has some of the pairs, with the places where they begin and end; slices are in order of the hashes."""
        of = (self.codes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield int(of[a]), a, b


def start_weights() -> np.ndarray:
    w = np.full((GATES, INPUTS), 1.0 / len(TABLE_BITS), np.float64)
    w[:, -1] = 0.0
    return w


# --- the corpus as blocks of units ---------------------------------------------------------------------------------


def unit_counts(learnt: list[tuple[int, np.ndarray]], experts: int, units: int) -> np.ndarray:
    """How often each expert's texts ``(expert, unit numbers)`` hold each unit: a pass over the texts, not one over all units for each text."""
    counts = np.zeros((experts, units), np.int64)
    for expert in range(experts):
        seqs = [seq for e, seq in learnt if e == expert]
        if seqs:
            counts[expert] = np.bincount(np.concatenate(seqs), minlength=units)
    return counts


def _unit_blocks(docs: DataFrame, id_col: str, text_col: str, group_col: str | None, held: Column, groups: list, limit: int, slices: int = SLICES) -> DataFrame:
    """Block rows: documents as unit numbers, and sliced units with their training counts per expert."""
    return written(_block_rows(docs, id_col, text_col, group_col, held, groups, limit, slices, False), "lm-blocks")


def _pair_blocks(docs: DataFrame, id_col: str, text_col: str, group_col: str | None, held: Column, groups: list, limit: int, slices: int) -> tuple[DataFrame, DataFrame, str]:
    """The rows of ``_unit_blocks``; sliced pairs, in ``words`` as the steps between their hashes, with their training counts; and the folder of the latter."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "lm-blocks")
    rows = _block_rows(docs, id_col, text_col, group_col, held, groups, limit, slices, True)
    with shuffles_dropped(spark):
        rows.write.option("compression", "zstd").partitionBy("pair").parquet(path)
    # One folder each: an empty one is not written.
    whole = spark.read.schema(rows.schema).parquet(path)
    return whole.where("not pair").drop("pair"), whole.where("pair").select("slice", "block", "words", "counts"), f"{path}/pair=true"


def _block_rows(docs: DataFrame, id_col: str, text_col: str, group_col: str | None, held: Column, groups: list, limit: int, slices: int, pairs: bool) -> DataFrame:
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("bytes", T.LongType()), T.StructField("seq", T.BinaryType()), T.StructField("slice", T.IntegerType()), T.StructField("words", T.BinaryType()),
                           T.StructField("numbers", T.BinaryType()), T.StructField("counts", T.BinaryType()), *([T.StructField("pair", T.BooleanType())] if pairs else [])])
    experts = max(1, len(groups))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        number, chars, units, learnt, texts = 0, 0, Numbering(), [], []

        def rows(**columns) -> pa.RecordBatch:
            n = len(columns["block"])
            columns.setdefault("pair", [False] * n)
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)

        def close() -> pa.RecordBatch:
            words = list(units)
            counts = unit_counts(learnt, experts, len(words))
            # All units of a word fall into one slice, and words that begin alike into different ones.
            found = [(k, pack_words([words[i] for i in part]), pack(part), pack_counts(counts[:, part].ravel())) for k, part in slice_parts([word_of(w) for w in words], slices)]
            at, packed, numbers, counted = zip(*found, strict=True) if found else ((), (), (), ())
            return rows(block=[block_id(number)] * len(at), slice=at, words=packed, numbers=numbers, counts=counted)

        def close_pairs() -> Iterator[pa.RecordBatch]:
            if pairs and texts:
                found = Pairs([seq for _, seq in texts], unit_hashes(list(units)))
                counts, steps = found.counts(experts, np.array([e for e, _ in texts])), np.diff(found.codes, prepend=np.uint64(0))
                at, packed, counted = zip(*((k, pack(np.concatenate([found.codes[a:a + 1], steps[a + 1:b]]), 8), pack(counts[:, a:b].ravel())) for k, a, b in found.slices(slices)), strict=True)
                yield rows(block=[block_id(number)] * len(at), slice=at, words=packed, counts=counted, pair=[True] * len(at))

        for batch in batches:
            ids, flags, sizes, seqs, at = [], [], [], [], []
            for key, text, out_of, expert in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = units_of(text)
                seq = np.fromiter(map(units.__getitem__, found), np.uint32, len(found))
                if not out_of:
                    learnt.append((expert, seq))
                if pairs:
                    texts.append((-1 if out_of else expert, seq))
                ids.append(key)
                flags.append(out_of)
                sizes.append(sum(map(len, found)) - 2)
                seqs.append(pack(seq))
                at.append(block_id(number))
                chars += len(text or "") + 100
                if chars >= limit:
                    yield close()
                    yield from close_pairs()
                    number, chars, units, learnt, texts = number + 1, 0, Numbering(), [], []
            yield rows(block=at, id=ids, held_out=flags, bytes=sizes, seq=seqs)
        yield close()
        yield from close_pairs()

    expert = F.lit(experts - 1)
    for k, value in enumerate(groups if groups[-1] is not None else groups[:-1]):
        expert = F.when(F.col(group_col) == value, k).otherwise(expert)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"), expert.cast("int").alias("expert"))
    return given.mapInArrow(cut, schema)


def _pair_counts(pairs: DataFrame, experts: int, tasks: int) -> DataFrame:
    """``(slice, block, counts)``: the training counts of each block's pairs over the whole corpus, in the order of their hashes; and per slice a row without
    block that has ``(kinds, once)``, each expert's distinct pairs and those that occur once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            codes = [np.cumsum(steps, dtype=np.uint64) for _, steps, _ in held]
            every, of = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.zeros((experts, len(every)), np.int64)
            ends = np.cumsum([len(c) for c in codes]).tolist()
            for a, b, (_, _, counts) in zip([0, *ends], ends, held, strict=False):
                total[:, of[a:b]] += counts  # a block's pairs are distinct
            blocks = [block for block, _, _ in held]
            packed = [pack_counts(total[:, of[a:b]].ravel()) for a, b in zip([0, *ends], ends, strict=False)]
            none = [None] * len(blocks)
            return pa.RecordBatch.from_arrays([pa.array([now] * (len(blocks) + 1), pa.int32()), pa.array([*blocks, None], pa.int64()), pa.array([*packed, None], pa.binary()),
                                               *(pa.array([*none, n.tolist()], pa.list_(pa.int64())) for n in ((total > 0).sum(axis=1), (total == 1).sum(axis=1)))],
                                              names=["slice", "block", "counts", "kinds", "once"])

        for batch in batches:
            for part, block, steps, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now and held:
                    yield out()
                    held = []
                now = part
                held.append((block, unpack(steps, 8), unpack(counts).reshape(experts, -1)))
        if held:
            yield out()

    rows = pairs.repartition(tasks, "slice").sortWithinPartitions("slice")
    return written(rows.mapInArrow(add, "slice int, block long, counts binary, kinds array<bigint>, once array<bigint>"), "lm-pairs")


def _growth(units: DataFrame, pair_counts: DataFrame, experts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each expert the power and the scale of ``after_another``, and its number of texts."""
    each = [F.sum(F.col(c)[e]).alias(f"{c}{e}") for c in ("kinds", "once") for e in range(experts)]
    sums = pair_counts.where("block is null").agg(*each).first()
    kinds, once = (np.array([sums[f"{c}{e}"] or 0 for e in range(experts)], np.float64) for c in ("kinds", "once"))
    power = once / np.maximum(kinds, 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, powers = np.zeros(experts), np.zeros(experts)
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last = np.array([w[-2:] == b"  " for w in unpack_words(words)], bool)
                counted = unpack_counts(counts).reshape(experts, -1)
                texts += counted[:, last].sum(axis=1)
                for e in range(experts):
                    some = counted[e, ~last]
                    powers[e] += (some[some > 0].astype(np.float64) ** power[e]).sum()
        yield pa.RecordBatch.from_arrays([pa.array([n.tolist()], pa.list_(pa.float64())) for n in (texts, powers)], names=["texts", "powers"])

    found = _over_units(units, add, "texts array<double>, powers array<double>").collect()
    texts, powers = (np.sum([np.zeros(experts), *(np.array(r[c]) for r in found)], axis=0) for c in ("texts", "powers"))
    powers += np.where(texts > 0, texts ** power, 0.0)
    return power, kinds / np.maximum(powers, 1e-300), texts


def _merged_units(blocks: DataFrame, experts: int, tasks: int = SLICE_TASKS) -> DataFrame:
    """``(slice, words, counts, tokens, distinct, sizes, once)``: every distinct unit once, with its training counts; occurrences of words,
    known words; each expert's occurrences of units, and its units that occur once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, units, parts = None, Numbering(), []

        def out() -> pa.RecordBatch:
            words = list(units)
            counts = np.zeros((experts, len(words)), np.int64)
            for places, c in parts:
                counts[:, places] += c  # a row's units are distinct
            total = counts.sum(axis=0)
            known = {word_of(w) for w, n in zip(words, total.tolist(), strict=True) if n} - {b""}
            tokens = int(sum(n for w, n in zip(words, total.tolist(), strict=True) if word_of(w)))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack_words(words)], pa.binary()), pa.array([pack_counts(counts.ravel())], pa.binary()),
                                               pa.array([tokens], pa.int64()), pa.array([len(known)], pa.int64()), *(pa.array([n.tolist()], pa.list_(pa.int64())) for n in (counts.sum(axis=1), (counts == 1).sum(axis=1)))],
                                              names=["slice", "words", "counts", "tokens", "distinct", "sizes", "once"])

        for batch in batches:
            for part, words, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part != now and now is not None:
                    yield out()
                    units, parts = Numbering(), []
                now = part
                found = unpack_words(words)
                places = np.fromiter(map(units.__getitem__, found), np.int64, len(found))
                counted = unpack_counts(counts).reshape(experts, -1)
                some = counted.any(axis=0)
                if some.any():
                    parts.append((places[some], counted[:, some]))
        if now is not None:
            yield out()

    rows = blocks.where("slice is not null").select("slice", "words", "counts").repartition(tasks, "slice").sortWithinPartitions("slice")
    return written(rows.mapInArrow(merge, "slice int, words binary, counts binary, tokens long, distinct long, sizes array<bigint>, once array<bigint>"), "lm-units")


def _over_units(units: DataFrame, task, schema: str) -> DataFrame:
    return units.select("words", "counts").mapInArrow(task, schema)


def _symbol_counts(units: DataFrame, experts: int) -> np.ndarray:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(257, np.int64)
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in zip(unpack_words(words), unpack_counts(counts).reshape(experts, -1).sum(axis=0).tolist(), strict=True):
                    if n:
                        end = w[-2:] == b"  "
                        np.add.at(out, np.frombuffer(w[:-2] if end else w, np.uint8), n)
                        out[END] += n * end
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.int64()))], names=["n"])

    return np.sum([np.zeros(257, np.int64), *(np.array(r["n"]) for r in _over_units(units, task, "n array<bigint>").collect())], axis=0)


def _trained_units(batch: pa.RecordBatch, experts: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(expert, units, counts) of the units that an expert's training texts hold, some at a time."""
    for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        every, counted = unpack_words(words), unpack_counts(counts).reshape(experts, -1)
        order = np.array(sorted(range(len(every)), key=every.__getitem__), np.int64)
        for expert in range(experts):
            some = order[counted[expert, order] > 0]
            for a in range(0, len(some), _UNITS_AT_ONCE):
                part = some[a:a + _UNITS_AT_ONCE]
                yield expert, [every[i] for i in part], counted[expert, part]


def _count_tables(units: DataFrame, codes: np.ndarray, experts: int) -> tuple:
    """The predictors' counts, summed over all tasks chunk by chunk."""
    schema = "k int, chunk int, counts binary"
    spark = units.sparkSession
    shared = spark.sparkContext.broadcast(codes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((1 << b, 2), np.int64) for b in TABLE_BITS]
        for batch in batches:
            for expert, words, counted in _trained_units(batch, experts):
                bits = Bits(words, shared.value)
                n = bits.weights(counted)[bits.symbol]
                for k, t in enumerate(tables):
                    np.add.at(t.reshape(-1), bits.slots(k, expert) * 2 + bits.bit, n)
        for k, t in enumerate(tables):
            for c in range(0, len(t), CHUNK):
                if t[c:c + CHUNK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c // CHUNK], pa.int32()), pa.array([pack_counts(t[c:c + CHUNK].ravel())], pa.binary())], names=["k", "chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([pack_counts(total)], pa.binary())], names=["k", "chunk", "counts"])

        for batch in batches:
            for k, c, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (k, c) != now and now is not None:
                    yield out()
                    total = None
                now = (k, c)
                part = unpack_counts(packed)
                total = part if total is None else total + part
        if now is not None:
            yield out()

    summed = _over_units(units, count, schema).repartition("k", "chunk").sortWithinPartitions("k", "chunk").mapInArrow(add, schema)
    tables = [np.zeros((1 << b, 2), np.float32) for b in TABLE_BITS]
    for r in summed.collect():  # as many numbers as TABLE_BITS says, whatever the corpus
        part = unpack_counts(r["counts"]).reshape(-1, 2)
        tables[r["k"]][r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(part)] = part
    return tuple(tables)


def _learn_weights(units: DataFrame, shared, experts: int) -> np.ndarray:
    """Rounds of online learning in every task, averaged by the number of bits; ``shared`` is the packed model's broadcast."""
    weights = start_weights()
    for turn in range(ROUNDS):
        now = weights.copy()

        def learn(batches: Iterator[pa.RecordBatch], now=now, rate=RATE / (1 + turn)) -> Iterator[pa.RecordBatch]:
            w, held, mass = now.copy(), opened_model(shared.value), np.zeros(GATES)
            for batch in batches:
                for expert, words, counted in _trained_units(batch, experts):
                    bits = Bits(words, held.codes)
                    x, gate = bits.counted(held, expert)
                    n = bits.weights(counted)[bits.symbol].astype(np.float64)
                    for a in range(0, len(gate), 8192):
                        xs, g, m, y = x[a:a + 8192], gate[a:a + 8192], n[a:a + 8192], bits.bit[a:a + 8192]
                        p = 1 / (1 + np.exp(-np.clip(np.einsum("bf,bf->b", xs, w[g]), -18, 18)))
                        wrong = (y - p) * m
                        step = np.stack([np.bincount(g, weights=wrong * xs[:, f], minlength=GATES) for f in range(INPUTS)], axis=1)
                        here = np.bincount(g, weights=m, minlength=GATES)
                        # Steps shrink with the size of the inputs: a frequent certain context has large ones.
                        size = np.bincount(g, weights=m * np.einsum("bf,bf->b", xs, xs), minlength=GATES)
                        w += rate * step / (size + here + 1)[:, None] * 4
                        mass += here
            yield pa.RecordBatch.from_arrays([pa.array([w.ravel().tolist()], pa.list_(pa.float64())), pa.array([mass.tolist()], pa.list_(pa.float64()))], names=["w", "mass"])

        rows = _over_units(units, learn, "w array<double>, mass array<double>").collect()
        mass = np.array([r["mass"] for r in rows]).reshape(len(rows), GATES, 1)
        each = np.array([r["w"] for r in rows]).reshape(len(rows), GATES, INPUTS)
        total = mass.sum(axis=0)
        weights = np.where(total > 0, (each * mass).sum(axis=0) / np.maximum(total, 1), weights)
    return weights


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang", limit: int = BLOCK_CHARS, pairs: bool = False) -> DataFrame:
    """One row per document: id, held_out, counts of tokens, the smoothed unigram score, the model's, and its total bits and bits per byte.

    ``held`` says which documents are scored only. Without ``pairs`` no unit is seen together with the one before it.
    """
    groups: list = [None]
    if group_col is not None:
        counts = docs.where(~held).groupBy(group_col).count().orderBy(F.col(group_col).isNull(), F.desc("count"), group_col).limit(EXPERTS + 1).collect()
        groups = [r[0] for r in counts if r[0] is not None]
        # The last expert stands for all other groups, if there are any.
        groups = groups if len(groups) == len(counts) <= EXPERTS and groups else groups[:EXPERTS - 1] + [None]
    experts = len(groups)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    slices = max(SLICES, -(-chars // SLICE_CHARS))
    tasks = SLICE_TASKS * slices // SLICES
    if pairs:
        blocks, found_pairs, folder = _pair_blocks(docs, id_col, text_col, group_col, held, groups, limit, slices)
        pair_counts = _pair_counts(found_pairs, experts, tasks)
        delete_path(docs.sparkSession, folder)  # read for the last time
    else:
        blocks = _unit_blocks(docs, id_col, text_col, group_col, held, groups, limit, slices)
    units = _merged_units(blocks, experts, tasks)
    power, scale, texts = _growth(units, pair_counts, experts) if pairs else (None, None, None)
    per_expert = [F.sum(F.col(c)[e]).alias(f"{c}{e}") for c in ("sizes", "once") for e in range(experts)]
    sums = units.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"), *per_expert).first()
    sizes, once = (np.array([sums[f"{c}{e}"] or 0 for e in range(experts)], np.float64) for c in ("sizes", "once"))
    learnt = blocks.where("slice is null and not held_out").count()
    tokens, distinct = (sums["tokens"] or 0) + learnt, (sums["distinct"] or 0) + (learnt > 0)

    model = Model(huffman(_symbol_counts(units, experts)))
    model = replace(model, tables=_count_tables(units, model.codes, experts))
    priors = np.full(experts, -np.log(experts))
    shared = docs.sparkSession.sparkContext.broadcast(packed_model(model))
    weights = _learn_weights(units, shared, experts)
    del model

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's units first, scored by every expert; then the blocks' words find theirs."""
        now, places, scores, occurs = None, {}, None, None
        scorer = Scorer(replace(opened_model(shared.value), weights=weights), experts)
        for batch in batches:
            blocks_, numbers_, known_, scores_, hashes_, counts_ = [], [], [], [], [], []
            for part, block, words, numbers, counts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found = unpack_words(words)
                if block is None:
                    now, places = part, {w: i for i, w in enumerate(found)}
                    counted = unpack_counts(counts).reshape(experts, -1)
                    scores = with_counts(scorer.log10(found), counted.T, sizes, once).astype(np.float32)
                    whole, total = Numbering(), counted.sum(axis=0)
                    of = np.fromiter((whole[word_of(w)] for w in found), np.int64, len(found))
                    occurs = np.bincount(of, weights=total, minlength=len(whole))[of].astype(np.int64)
                    continue
                assert part == now
                at = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
                real = np.fromiter((word_of(w) != b"" for w in found), bool, len(found))
                blocks_.append(block)
                numbers_.append(numbers)
                known_.append(np.where(real, occurs[at], -1).astype("<i8").tobytes())
                scores_.append(scores[at].tobytes())
                hashes_.append(unit_hashes(found).tobytes() if pairs else None)
                counts_.append(pack_counts(counted[:, at].ravel()) if pairs else None)
            yield pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), *(pa.array(c, pa.binary()) for c in (numbers_, known_, scores_, hashes_, counts_)), pa.nulls(len(blocks_), pa.int32())],
                                             names=["block", "numbers", "occurs", "scores", "hashes", "counts", "pairs"])

    every = units.select("slice", F.lit(None).cast("long").alias("block"), "words", F.lit(None).cast("binary").alias("numbers"), "counts").union(
        blocks.where("slice is not null").select("slice", "block", "words", "numbers", F.lit(None).cast("binary")))
    values = every.repartition(tasks, "slice").sortWithinPartitions("slice", F.col("block").asc_nulls_first()).mapInArrow(
        look_up, "block long, numbers binary, occurs binary, scores binary, hashes binary, counts binary, pairs int")
    if pairs:
        values = values.unionByName(pair_counts.where("block is not null").select("block", "counts", F.col("slice").alias("pairs")), allowMissingColumns=True)
    space = np.log10(tokens + distinct + 1)

    def after_each_other(seqs: list[np.ndarray], hashes: np.ndarray, counts: np.ndarray, scores: np.ndarray, found: pa.Table) -> np.ndarray:
        """Natural logarithms of the texts' probabilities, a row per text and a column per expert; what the pairs' slices found comes in order of their hashes."""
        some, out = Pairs(seqs, hashes), np.empty((len(seqs), experts))
        packed = found.column("counts").to_pylist()
        for e in range(experts):
            # One expert's at a time: together they would take as much memory as all the rest.
            total = np.concatenate([_narrow(unpack(c, 8).reshape(experts, -1)[e]) for c in packed])
            assert len(total) == len(some.codes)
            value = after_another(scores[:, e] * np.log(10), np.append(counts[e], texts[e]), power[e], scale[e], some.before, some.now, total)
            out[:, e] = np.add.reduceat(value[some.of], some.starts)
        return out

    def rebuild(rows: pa.Table, found: pa.Table) -> pa.Table:
        if pairs:
            _give_back()
        by_pair = found.filter(pc.is_valid(found.column("pairs"))).sort_by("pairs")
        found = found.filter(pc.is_null(found.column("pairs")))
        numbers = np.concatenate([np.empty(0, np.uint32), *map(unpack, found.column("numbers").to_pylist())])
        raw = lambda name, kind: np.frombuffer(b"".join(found.column(name).to_pylist()), kind)
        occurs, scores = np.empty(len(numbers), np.int64), np.empty((len(numbers), experts))
        occurs[numbers], scores[numbers] = raw("occurs", "<i8"), raw("scores", "<f4").reshape(-1, experts)
        base = np.where(occurs >= 0, np.log10(np.maximum(occurs, 0) + 1) - space, 0.0)
        n_tokens, n_known, base_score, score = [], [], [], []
        seqs = [unpack(packed) for packed in rows.column("seq").to_pylist()]
        if pairs and seqs:
            hashes, counts = np.empty(len(numbers), np.uint64), np.empty((experts, len(numbers)), np.int64)
            hashes[numbers] = raw("hashes", "<u8")
            counts[:, numbers] = np.concatenate([unpack_counts(c).reshape(experts, -1) for c in found.column("counts").to_pylist()], axis=1)
            logs = after_each_other(seqs, hashes, counts, scores, by_pair)
        for at, seq in enumerate(seqs):
            c = occurs[seq]
            n_tokens.append(int((c >= 0).sum()) + 1)
            n_known.append(int((c > 0).sum()) + (learnt > 0))
            base_score.append(float(base[seq].sum() + np.log10(learnt + 1) - space))
            each = (logs[at] if pairs else scores[seq].sum(axis=0) * np.log(10)) + priors
            score.append(float(np.logaddexp.reduce(each) / np.log(10)))
        bits = [-s / np.log10(2) for s in score]
        per_byte = [b / n if n else None for b, n in zip(bits, rows.column("bytes").to_pylist(), strict=True)]
        return pa.table([pa.array(rows.column("id").to_pylist(), rows.schema.field("id").type), rows.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                         pa.array([tokens] * len(score), pa.int64()), pa.array(base_score, pa.float64()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(per_byte, pa.float64())],
                        names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "total_bits", "bits_per_byte"])

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, total_bits double, bits_per_byte double").fields]
    return reassemble(blocks, values, rebuild, T.StructType(fields))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out(), pairs=True)
