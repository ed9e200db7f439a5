"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one holds what is frequent in ordinary
texts, the other adds what toxic texts have beside it. A window of words is compressed with
either; what the second saves is its distance. Windows of ordinary text come out alike, so the
largest and the summed savings of a text tell how much toxic wording it holds. A logistic fit
calibrates them on labelled texts, each measured with dictionaries that have not seen it.

Compressed in plain letters, a six-letter word saves little more than the match costs, and half
matches of ordinary syllables drown it. Words are therefore written in fixed-length codes, for
the first four bytes, the first six bytes and the whole word: a code matches wholly or not at all.

Codes are counted by the different contexts (word before, word after) in which they stand, not by
documents, so a text with many copies proves nothing; a code goes into the toxic dictionary if its
share of toxic contexts is significantly high.

The fit sees at most ``MOST_TOXIC`` toxic and ``MOST_ORDINARY`` ordinary labelled texts (whole
texts, drawn by a hash of the id); every document is scored in full. Contexts and codes are
counted in the executors: the driver sees the codes that enter a dictionary and a few numbers per
drawn text, no text. The model has the size of its dictionaries (some 50 kB) whatever the data.

Edge cases: null and empty texts have no window and get the score of a text without savings;
rows without an id are scored, never learnt from; repeated labels of one id count as toxic if
any says so; of several texts with one id the smallest is learnt from; labels that are null are ignored; without toxic or without ordinary labels every
score is the share of toxic labels (0 without labels); input columns beside id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

MOST_TOXIC = 2000
MOST_ORDINARY = 5000
#: Words of a window.
WINDOW = 12
#: Word beginnings with a code of their own, and bytes of a code.
BEGINNINGS, CODE = (4, 6), 6
LEVEL, MIN_MATCH = 6, 5
ORDINARY_BYTES, TOXIC_BYTES = 24_576, 24_576
THRESHOLD = 0.3
#: Bytes of text that a task handles at a time, and words whose codes it keeps.
PIECE, KEPT_CODES = 2_000_000, 200_000

#: Columns of a word's codes.
_CODES = tuple(f"c{i}" for i in range(len(BEGINNINGS) + 1))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Codes(dict):
    """The codes of words, kept for the frequent ones: emptied when it grows past a bound."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh3_64_digest

        if len(self) > KEPT_CODES:
            self.clear()
        parts = [xxh3_64_digest(word[:n], seed=n)[:CODE] for n in BEGINNINGS] + [xxh3_64_digest(word)[:CODE]]
        code = self[word] = b"".join(parts)
        return code


def windows_of(words: Sequence[bytes], codes: Codes) -> list[bytes]:
    return [b"".join(map(codes.__getitem__, words[i:i + WINDOW])) for i in range(0, len(words), WINDOW)]


#: Flags of a context: the class and the half of a text in which it stands.
def _flag(toxic: int, half: int) -> int:
    return 1 << (2 * toxic + half)


def pieces(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with some ``PIECE`` bytes of text (a longer text stands alone), so that memory does not grow with the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(toxic, half, text)`` the distinct contexts of a piece (as 64-bit hashes), their flag, and the codes of the word in them."""
    from xxhash import xxh3_64_intdigest

    codes = Codes()
    for batch in (part for whole in batches for part in pieces(whole, 2)):
        names: dict[bytes, int] = {}
        held = []
        for toxic, half, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            w = np.array([names.setdefault(x, len(names)) for x in words_of(text)], np.int64)
            if len(w):
                held.append((w, _flag(toxic, half)))
        if not held:
            continue
        hashes = np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names))
        contexts, words, flags = [], [], []
        for w, flag in held:
            h = np.zeros(len(w) + 2, np.uint64)
            h[1:-1] = hashes[w]
            mixed = (h[:-2] * _MIX[0] + h[1:-1]) * _MIX[1] + h[2:]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
            contexts.append((mixed ^ (mixed >> np.uint64(32))).view(np.int64))
            words.append(w)
            flags.append(np.full(len(w), flag, np.int64))
        context, word, flag = map(np.concatenate, (contexts, words, flags))
        first = np.unique(np.stack([context, flag]), axis=1, return_index=True)[1]
        whole = np.frombuffer(b"".join(map(codes.__getitem__, names)), np.uint8).reshape(len(names), -1, CODE).astype(np.int64)
        numbers = (whole << (8 * np.arange(CODE - 1, -1, -1))).sum(axis=2)[word[first]]
        yield pa.RecordBatch.from_arrays([pa.array(context[first]), pa.array(flag[first], pa.int32()), *(pa.array(c) for c in numbers.T)], names=["context", "flag", *_CODES])


def _listed(codes: DataFrame, order: Column, most: int) -> bytes:
    """The codes largest in ``order``, the largest last."""
    best = codes.orderBy(order.desc(), F.desc("code")).limit(most).select("code").collect()  # at most a dictionary's codes
    return b"".join(int(r[0]).to_bytes(CODE, "big") for r in reversed(best))


def dictionaries(rows: DataFrame, tellings: Sequence[Sequence[int]]) -> list[tuple[bytes, bytes]]:
    """For each telling (a list of halves) the ordinary and the toxic dictionary of its texts; the strongest codes stand last, nearest to the window.

    ``rows`` has toxic, half and text. Contexts are told apart, and codes counted, in the executors;
    only the codes that pass come to the driver.
    """
    seen = rows.select(F.col("toxic").cast("int"), F.col("half").cast("int"), "text").mapInArrow(_contexts, "context long, flag int, " + ", ".join(f"{c} long" for c in _CODES))
    once = seen.groupBy("context").agg(F.bit_or("flag").alias("flags"), *[F.min(c).alias(c) for c in _CODES])

    def told(halves: Sequence[int]) -> tuple[Column, Column]:
        """Whether a context counts, and whether as a toxic one: one that stands in no ordinary text."""
        plain = F.col("flags").bitwiseAND(F.lit(sum(_flag(0, h) for h in halves))) != 0
        bad = F.col("flags").bitwiseAND(F.lit(sum(_flag(1, h) for h in halves))) != 0
        return plain | bad, bad & ~plain

    names = [(f"n{i}", f"k{i}", *told(halves)) for i, halves in enumerate(tellings)]
    sums = [F.count_if(c).alias(name) for n, k, every, toxic in names for name, c in ((n, every), (k, toxic))]
    once = written(once, "toxicity-contexts")
    alike = once.select("flags", F.explode(F.array_distinct(F.array(*_CODES))).alias("code"))
    totals = once.agg(*sums).first()
    counts = written(alike.groupBy("code").agg(*sums), "toxicity-codes")
    out = []
    for i in range(len(tellings)):
        n, k = F.col(f"n{i}"), F.col(f"k{i}")
        ordinary = _listed(counts.where(n > k), n - k, ORDINARY_BYTES // CODE)
        every, bad = totals[f"n{i}"], totals[f"k{i}"]
        if not bad or bad == every:
            out.append((ordinary, b""))
            continue
        share = bad / every
        gain = 2 * k * F.log(k / n / share) + F.when(k < n, 2 * (n - k) * F.log((1 - k / n) / (1 - share))).otherwise(0.0)
        out.append((ordinary, _listed(counts.where((k >= 3) & (k / n >= 0.6) & (gain >= 20)), gain, TOXIC_BYTES // CODE)))
    return out


class Distance:
    """Savings of the windows of a text by the toxic dictionary."""

    def __init__(self, model: Model):
        self.plain = self._compressor(model.ordinary)
        # Toxic segments stand before the ordinary part: its matches keep their offsets, and ordinary windows their lengths.
        self.toxic = self._compressor(model.toxic + model.ordinary)
        self.codes = Codes()

    @staticmethod
    def _compressor(data: bytes):
        import zstandard

        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(data), source_size=256, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        if len(data) < 8:
            return zstandard.ZstdCompressor(compression_params=params)
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=params)

    def savings(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        cut = [windows_of(words_of(t), self.codes) for t in texts]
        out, group, size = [], [], 0
        flat: list[np.ndarray] = []
        for w in cut:
            group.extend(w)
            if len(group) >= 20_000:
                flat.append(self._lengths(self.plain, group) - self._lengths(self.toxic, group))
                group = []
        if group:
            flat.append(self._lengths(self.plain, group) - self._lengths(self.toxic, group))
        every = np.concatenate(flat) if flat else np.empty(0, np.int64)
        for w in cut:
            out.append(every[size:size + len(w)])
            size += len(w)
        return out

    @staticmethod
    def _lengths(compressor, windows: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, compressor.multi_compress_to_buffer(windows, threads=1)), np.int64, len(windows))


def features(saved: np.ndarray) -> list[float]:
    top = float(saved.max()) if len(saved) else 0.0
    high = saved[saved >= 3]
    n = math.log1p(len(saved))
    return [min(top, 24.0) / 8, math.log1p(float(high.sum())), math.log1p(len(high)), math.log1p(int((saved >= 10).sum())), n, math.log1p(len(high)) * n, float(top >= 3)]


FEATURES = 7


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _drawn(labelled: DataFrame, toxic: int, most: int) -> DataFrame:
    return labelled.where(F.col("toxic") == toxic).orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled documents; the caller has taken out the rows not to learn from."""
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(
        "id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model(b"", b"", (), prior)
    drawn = _drawn(labelled, 1, most_toxic).union(_drawn(labelled, 0, most_ordinary))
    # At most most_toxic + most_ordinary rows of two numbers: small enough to send to every task.
    # Of several texts with one id the smallest counts, on every run.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    half = F.conv(F.substring(F.md5(F.concat(F.lit("half"), F.col("id").cast("string"))), 1, 4), 16, 10).cast("int") % 2
    rows = written(rows.select("id", "text", "toxic", half.alias("half")), "toxicity-drawn")
    spark = docs.sparkSession
    classes = {tuple(r) for r in rows.select("half", "toxic").distinct().collect()}
    without = dictionaries(rows, [(1,), (0,), (0, 1)])
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, toxic bigint, f array<double>"
    measured = []
    # Each half is measured, in parallel, with the dictionaries of the other; a few numbers per text come back.
    for k in (0, 1):
        if {(1 - k, 0), (1 - k, 1)} <= classes and classes & {(k, 0), (k, 1)}:
            other = Model(*without[k], (), prior)
            texts = rows.where(F.col("half") == k).select("id", "text", "toxic").repartition(spark.sparkContext.defaultParallelism)
            measured.append(texts.mapInArrow(_feature_task(spark, other, 1), schema).toPandas().sort_values("id"))
    ordinary, toxic = without[2]
    if not measured:
        return Model(ordinary, toxic, (), prior)
    back = pd.concat(measured)
    y = back["toxic"].to_numpy().astype(float)
    n1 = max(1.0, y.sum())
    weight = np.where(y == 1, prior * len(y) / n1, (1 - prior) * len(y) / max(1.0, len(y) - n1))
    w = fit(np.array(back["f"].tolist()).reshape(len(back), FEATURES), y, weight)
    return Model(ordinary, toxic, tuple(float(v) for v in w), prior)


def _feature_task(spark: SparkSession, model: Model, text_at: int):
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(shared.value)
        for batch in (part for whole in batches for part in pieces(whole, text_at)):
            f = [features(s) for s in distance.savings(batch.column(text_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int64()), pa.array(f, pa.list_(pa.float64()))], names=["id", "toxic", "f"])

    return task


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs``: id, the columns in ``keep``, and score."""
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    out = list(dict.fromkeys([id_col, *keep]))
    schema = T.StructType([*(docs.schema[c] for c in out), T.StructField("score", T.DoubleType())])
    if not model.weights:
        return docs.select(*out, F.lit(model.prior).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(shared.value)
        w = np.array(shared.value.weights)
        text_at = columns.index(text_col)
        for batch in (part for whole in batches for part in pieces(whole, text_at)):
            f = np.array([features(s) for s in distance.savings(batch.column(text_at).to_pylist())])
            p = 1 / (1 + np.exp(-np.clip(f @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in out), pa.array(p)], names=schema.names)

    return docs.select(*columns).mapInArrow(task, schema)


def held_out(id_col: str = "doc_id"):
    """The contract's held-out rows; a row without an id is not among those learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
