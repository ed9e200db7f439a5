"""Nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts: vectors are halved along their
widest direction until there are enough parts, then nodes move to the part that holds most of their
neighbours while parts keep their size. A small network learns from that which parts hold the
neighbours of a vector. It gives every vector of the table its part, and routes a query to its most
probable parts; their vectors are compared exactly, in double precision, block by block.

How many parts a query needs is measured: some audit queries are compared with all vectors, and the
routes are made as long as it takes to reach ``RECALL`` of their true neighbours (with vectors that
have no structure that can be most parts). Parts need not be even on the whole table: they are
dealt into blocks of bounded size.

Equal vectors are one node with its smallest ids: among vectors with one score the smallest ids
come first, so a list of ``top`` + 1 of them holds all that can ever be an answer.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite entry take no part,
neither do rows without an id; of different vectors with one id the one with the smallest key takes
part, and a repeated row counts once; vectors of different lengths are searched apart; a query with
fewer candidates than ``top`` gets all of them (routes go on until they hold enough); an empty table
gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

TOP = 20
#: Vectors from which the parts are learnt, parts, and neighbours of a node in their graph.
SAMPLE, PARTS, NEIGHBOURS = 8192, 64, 16
#: How much larger than the mean a part of the sample may be, and rounds of moves.
SLACK, ROUNDS = 1.1, 20
#: Units of the network's hidden layer, rounds of its training.
HIDDEN, EPOCHS = 64, 20
#: Queries of the audit, and the share of their neighbours that routes must reach.
AUDIT, RECALL = 256, 0.95
#: Vectors of a block, and queries that meet it at once.
ROW_BLOCK, QUERY_BLOCK = 16_384, 32_768


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each vector the ``k`` others with the largest inner product."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for a in range(0, n, 512):
        s = x[a:a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size (``parts`` a power of two): every group is cut in the middle of its widest direction."""
    part = np.zeros(len(x), np.int64)
    made = 1
    while made < parts:
        finer = 2 * part
        for p in range(made):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ direction, kind="stable")]
            finer[order[len(own) // 2:]] += 1
        part, made = finer, 2 * made
    return part


def balanced_parts(graph: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Nodes move to where most of their neighbours (by links of either direction) are, the greatest gains first, as long as there is room."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part, room = part.copy(), int(np.ceil(SLACK * n / parts))
    for _ in range(ROUNDS):
        near = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        gain = near - near[np.arange(n), part][:, None]
        size = np.bincount(part, minlength=parts)
        moved = 0
        best = gain.max(axis=1)
        for v in np.argsort(-best, kind="stable"):
            if best[v] <= 0:
                break
            to = int(np.argmax(np.where(size < room, gain[v], -1)))
            if gain[v, to] > 0 and size[to] < room:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if moved < n // 200 + 1:
            break
    return part


class Router:
    """A network with one hidden layer: the chance of each part to hold a vector's neighbours."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def learn(cls, x: np.ndarray, target: np.ndarray, seed: int = 5) -> Router:
        rng = np.random.default_rng(seed)
        n, d = x.shape
        parts = target.shape[1]
        w = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, (HIDDEN, parts)), np.zeros(parts)]
        first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, 256):
                rows = order[at:at + 256]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                wrong = (_softmax(h @ w[2] + w[3]) - target[rows]) / len(rows)
                back = (wrong @ w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ wrong, wrong.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] = w[i] - 0.005 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-9)
        return cls(w)

    def chances(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return _softmax(np.maximum(_unit(x) @ w[0] + w[1], 0) @ w[2] + w[3])

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, *self.weights)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Router:
        held = np.load(io.BytesIO(data))
        return cls([held[f"arr_{i}"] for i in range(4)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learnt(x: np.ndarray, parts: int) -> Router:
    """A router from a sample of vectors."""
    # A power of two, and enough vectors in each part to tell it from the others.
    parts = 1 << max(0, min(parts, len(x) // NEIGHBOURS).bit_length() - 1)
    unit = _unit(x)
    if parts == 1:
        return Router([np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)])
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(graph, halved(unit, parts), parts)
    own = np.zeros((len(x), parts))
    np.add.at(own, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    # A vector belongs to its own part as much as to its neighbours'.
    own[np.arange(len(x)), part] += graph.shape[1]
    return Router.learn(unit, own / own.sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat).astype(np.float64).reshape(-1, dim)


def _chances(rows: DataFrame, router: bytes, dim: int, most: bool) -> DataFrame:
    """``(node, part)`` of the most probable part, or ``(node, chances)`` of all."""
    shared = rows.sparkSession.sparkContext.broadcast(router)  # the size of the network

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Router.from_bytes(shared.value)
        for batch in batches:
            if batch.num_rows:
                p = model.chances(_matrix(batch.column(1), dim))
                values = pa.array(p.argmax(axis=1), pa.int32()) if most else pa.array(list(p), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["node", "p"])

    return rows.select("node", "v").mapInArrow(task, "node long, p int" if most else "node long, p array<double>")


def best_in_block(queries: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)`` of the ``top`` ids of a block for each query: largest inner product first, then the smallest id."""
    first = np.fromiter((i[0] for i in ids), np.int64, len(ids))
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = []
    keep = min(top, len(vectors))
    for a in range(0, len(queries), 256):
        q = queries[a:a + 256]
        s = q @ vectors.T
        last = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
        # A little below the last one, for what the order of summation changes.
        at, node = np.nonzero(s >= (last - 1e-12 * np.abs(s).max(axis=1))[:, None])
        score = np.concatenate([np.einsum("ij,ij->i", q[at[k:k + 65_536]], vectors[node[k:k + 65_536]]) for k in range(0, len(at), 65_536)])
        at, node, score = _ranked(at, first[node], score, top, node)
        # Every copy of a vector has its score.
        n = counts[node]
        at, score = np.repeat(at, n), np.repeat(score, n)
        copy = flat[np.repeat(starts[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at, copy, score = _ranked(at, copy, score, top, copy)
        out.append((at + a, copy, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ranked(at: np.ndarray, order: np.ndarray, score: np.ndarray, top: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((order, -score, at))
    at, value, score = at[by], value[by], score[by]
    rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
    return at[rank < top], value[rank < top], score[rank < top]


_FOUND = "node long, vec_id long, score double, part int"


def _searched(packs: DataFrame, routes: DataFrame, dim: int, top: int) -> DataFrame:
    """The best of every block for the queries routed to its part. ``packs``: part, block, blocks, vectors, ids; ``routes``: node, v, part."""
    counted = routes.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("asks"))
    sizes = packs.groupBy("part").agg(F.max("blocks").alias("blocks")).join(counted, "part")
    sizes = written(sizes, "ann-sizes")  # one row per part

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        one = lambda c, kind: pa.array([part.column(c)[0].as_py()], kind)
        return pa.table({"part": one("part", pa.int32()), "ask": one("ask", pa.int32()), "blocks": one("blocks", pa.int32()),
                         "nodes": pa.array([part.column("node").to_pylist()], pa.list_(pa.int64())), "asked": pa.array([_matrix(part.column("v"), dim).tobytes()], pa.binary())})

    dealt = routes.join(sizes, "part").withColumn("ask", F.pmod(F.xxhash64("node"), F.col("asks")).cast("int"))
    asked = written(dealt.select("part", "ask", "blocks", "node", "v").groupBy("part", "ask").applyInArrow(
        pack, "part int, ask int, blocks int, nodes array<long>, asked binary"), "ann-asked")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = packs.drop("blocks").join(sizes.select("part", "asks"), "part").select("part", "block", every("asks").alias("ask"), "vectors", "ids")
    right = asked.select("part", every("blocks").alias("block"), "ask", "nodes", "asked")

    def ask(group, there: pa.Table, here: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if there.num_rows and here.num_rows:
            vectors = np.frombuffer(there.column("vectors")[0].as_py(), "<f8").reshape(-1, dim)
            ids = [np.array(i, np.int64) for i in there.column("ids")[0].as_py()]
            nodes = np.array(here.column("nodes")[0].as_py(), np.int64)
            asked_by = np.frombuffer(here.column("asked")[0].as_py(), "<f8").reshape(-1, dim)
            at, vec_id, score = best_in_block(asked_by, vectors, ids, top)
            columns = [nodes[at], vec_id, score, np.full(len(at), group[0].as_py())]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "vec_id", "score", "part"])

    by = ["part", "block", "ask"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(ask, _FOUND)


def _first(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each node."""
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def _one_length(nodes: DataFrame, dim: int, is_query: Column, top: int, parts: int, recall: float) -> DataFrame:
    """``(node, vec_id, score, place)``: the ``top`` + 1 best ids of each query's vector, the query's own among them."""
    keep = top + 1

    def learn(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        return pa.table({"router": pa.array([learnt(_matrix(part.column("v"), dim), parts).to_bytes()], pa.binary())})

    # At most SAMPLE vectors, drawn by a hash, in one task.
    sample = nodes.orderBy("draw", "node").limit(SAMPLE).select(F.lit(0).alias("one"), "node", "v")
    router = sample.groupBy("one").applyInArrow(learn, "router binary").first()["router"]
    parts_of = written(_chances(nodes, router, dim, True).withColumnRenamed("p", "part"), "ann-parts")
    sizes = {r["part"]: r["count"] for r in parts_of.groupBy("part").count().collect()}  # one row per part
    blocks = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, -(-n // ROW_BLOCK))])

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        one = lambda c: pa.array([part.column(c)[0].as_py()], pa.int32())
        return pa.table({"part": one("part"), "block": one("block"), "blocks": one("blocks"), "vectors": pa.array([_matrix(part.column("v"), dim).tobytes()], pa.binary()),
                         "ids": pa.array([part.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))})

    dealt = nodes.join(parts_of, "node").withColumn("blocks", blocks[F.col("part")]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    packs = written(dealt.select("part", "block", "blocks", "node", "v", "ids").groupBy("part", "block").applyInArrow(
        pack, "part int, block int, blocks int, vectors binary, ids array<array<long>>"), "ann-packs")

    queries = nodes.where(is_query)
    chances = _chances(queries, router, dim, False)
    # Parts by falling chance, and how many vectors they hold so far.
    held = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, n)])
    order = F.transform(F.array_sort(F.transform("p", lambda c, i: F.struct((-c).alias("c"), i.alias("part")))), lambda s: s["part"])
    order = F.filter(order, lambda p: held[p].isNotNull())
    routed = written(queries.select("node", "v").join(chances.select("node", order.alias("route")), "node"), "ann-routes")
    # The audit: some queries meet every part; where do their true neighbours stand on their routes?
    audit = written(routed.orderBy(F.xxhash64("node"), "node").limit(AUDIT), "ann-audit")
    truth = _first(_searched(packs, audit.select("node", "v", F.explode("route").alias("part")), dim, keep), keep)
    places = truth.join(audit.select("node", "route"), "node").groupBy(F.array_position("route", F.col("part")).alias("at")).count().collect()  # one row per part
    enough, total, steps = 0, sum(r["count"] for r in places), len(sizes)
    for step in range(1, len(sizes) + 1):
        enough += sum(r["count"] for r in places if r["at"] == step)
        if enough >= recall * total:
            steps = step
            break
    # Every route goes on until it holds enough vectors.
    filled = F.aggregate("route", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("steps")), lambda a, p: F.struct(
        (a["n"] + held[p].cast("long")).alias("n"), F.when(a["n"] < keep, a["steps"] + 1).otherwise(a["steps"]).alias("steps")), lambda a: a["steps"])
    routes = routed.select("node", "v", F.explode(F.slice("route", F.lit(1), F.greatest(F.lit(steps), filled))).alias("part"))
    return _first(_searched(packs, routes, dim, keep), keep).select("node", "vec_id", "score", "place")


def nearest(embeddings: DataFrame, is_query, top: int = TOP, parts: int = PARTS, recall: float = RECALL,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found of each row whose id meets ``is_query`` (a function of the id's column)."""
    v = F.col("v")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0.0)
    given = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fit & F.col("id").isNotNull())
    v0 = F.transform(v, lambda c: c + F.lit(0.0))  # both zeros are one
    keyed = given.select("id", v0.alias("v")).withColumn("key", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), "v"))))
    rows = written(keyed, "ann-rows")
    owned = written(rows.groupBy("id").agg(F.min("key").alias("key")), "ann-owned")
    # Of a hot vector each task keeps its smallest ids before anything is shuffled.
    smallest = owned.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("at") <= top + 1)
    ids = smallest.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = owned.where(is_query(F.col("id")))
    asks = asked.select("key").distinct().withColumn("asks", F.lit(True))
    nodes = rows.groupBy("key").agg(F.first("v").alias("v")).join(ids, "key").join(asks, "key", "left")
    nodes = written(nodes.select("key", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("v").alias("dim"), F.xxhash64(F.lit("draw"), "key").alias("draw"),
                                 F.monotonically_increasing_id().alias("node")), "ann-nodes")
    dims = [r[0] for r in nodes.select("dim").distinct().orderBy("dim").collect()]  # lengths of vectors: one, as a rule
    found = [written(_one_length(nodes.where(F.col("dim") == d), d, F.col("asks"), top, parts, recall), "ann-found") for d in dims]
    if not found:
        return owned.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    lists = every.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))  # top + 1 of each
    lists = nodes.select("node", "key").join(lists, "node").select("key", "found")
    # A query leaves itself out of what was found for its vector.
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, top)
    return asked.join(lists, "key").select("id", F.posexplode(others).alias("at", "f")).select(
        F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op13_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
