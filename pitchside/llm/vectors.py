"""Embedding near-duplicates with hierarchical navigable small-world graphs, one per shard.

Vectors of one label (and length) are dealt into shards of bounded size by a hash. Each shard is
indexed by its own graph; every two shards of a label then meet once and query each other, and each queries
itself. A query's beam is widened while all of it lies above the threshold, and
the beams of a whole block are widened until an audit of some of its queries against brute force
passes; a beam as wide as the shard is one product with all of it. What is found is verified by its
cosine in double precision. A block's links stay in it: it returns one row per linked vector, with
the number of its links and the smallest key that they reach within the block, so a group of near
copies costs a row per member and block, not per pair. Distributed star steps join these into components.

Equal vectors of a label form one node with a number of copies, before anything is compared.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component, and vectors
without a label, link with nothing; vectors of different lengths are never compared; null ids take
part, but a component is named by its smallest id that is not null; an empty table gives an empty
result; other input columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import connected_components

#: Vectors of a shard.
SHARD = 8192
#: Neighbours of a node on the upper layers (twice as many on the lowest), and beam widths.
DEGREE, BUILD_BEAM, BEAM = 16, 64, 64
#: Queries that search together: their candidates' vectors stay in the processor's cache.
AT_ONCE = 64
#: Queries of an audit, and the share of true links it must find.
AUDIT, RECALL = 128, 0.995


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: int):
        self.unit, self.layers, self.entry = unit, layers, entry

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 7) -> Graph:
        n = len(unit)
        draws = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(1 - draws) / np.log(DEGREE)).astype(int), 6)
        order = np.lexsort((draws, -level))  # the upper layers stand first
        top = int(level.max()) if n else 0
        layers = [np.full((n, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        graph = cls(unit, layers, int(order[0]) if n else -1)
        done, size = 1, 32
        while done < n:
            batch = order[done:done + size]
            entries = np.full((len(batch), 1), graph.entry, np.int64)
            for k in range(top, -1, -1):
                there = level[batch] >= k
                ids, sims = graph._beam(unit[batch], entries, k, BUILD_BEAM if there.any() else 8)
                entries = ids[:, :8]
                if there.any():
                    graph._insert(batch[there], ids[there], sims[there], k)
            done, size = done + len(batch), min(1024, size * 2)
        return graph

    def _insert(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        """Links new nodes to what their beams found and to each other, and back."""
        among = self.unit[nodes] @ self.unit[nodes].T
        np.fill_diagonal(among, -np.inf)
        width = min(len(nodes), BUILD_BEAM)
        near = np.argpartition(-among, width - 1, axis=1)[:, :width]
        near_sims = np.take_along_axis(among, near, 1)
        ids = np.hstack([ids, np.where(np.isfinite(near_sims), nodes[near], -1)])
        sims = np.hstack([sims, near_sims])
        self.layers[k][nodes] = self._select(nodes, ids, sims, DEGREE, self.layers[k].shape[1])
        a, b = np.repeat(nodes, self.layers[k].shape[1]), self.layers[k][nodes].ravel()
        a, b = a[b >= 0], b[b >= 0]
        # Back links: targets with room take them, the others choose anew among old and new ones.
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        targets, starts, counts = np.unique(b, return_index=True, return_counts=True)
        most = self.layers[k].shape[1]
        rank = np.arange(len(b)) - np.repeat(starts, counts)
        fresh = np.full((len(targets), min(int(counts.max()), 4 * most) if len(counts) else 0), -1, np.int64)
        fits = rank < fresh.shape[1]
        fresh[np.repeat(np.arange(len(targets)), counts)[fits], rank[fits]] = a[fits]
        every = np.hstack([self.layers[k][targets].astype(np.int64), fresh])
        for part in range(0, len(targets), 512):
            t, c = targets[part:part + 512], every[part:part + 512]
            s = np.where(c >= 0, np.einsum("qd,qkd->qk", self.unit[t], self.unit[np.maximum(c, 0)]), -np.inf)
            self.layers[k][t] = self._select(t, c, s, most, most)

    def _select(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int, width: int) -> np.ndarray:
        """Neighbours that spread: a candidate counts if it is nearer to the node than to any chosen one; the nearest others fill up."""
        pool = min(ids.shape[1], 3 * DEGREE)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :pool]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        usable = (ids >= 0) & np.isfinite(sims) & (ids != nodes[:, None])
        for j in range(1, pool):  # repeated candidates
            usable[:, j] &= ~((ids[:, :j] == ids[:, j:j + 1]) & usable[:, :j]).any(axis=1)
        vectors = self.unit[np.maximum(ids, 0)]
        chosen = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -np.inf)
        for j in range(pool):
            take = usable[:, j] & (sims[:, j] > closest[:, j]) & (chosen.sum(axis=1) < most)
            chosen[:, j] = take
            if take.any():
                closest = np.where(take[:, None], np.maximum(closest, np.einsum("qkd,qd->qk", vectors, vectors[:, j])), closest)
        rank = np.where(chosen, 0, np.where(usable, 1, 2)) * pool + np.arange(pool)
        keep = np.argsort(rank, axis=1)[:, :most]
        kept = np.where(np.take_along_axis(usable, keep, 1), np.take_along_axis(ids, keep, 1), -1)
        out = np.full((len(nodes), width), -1, np.int32)
        out[:, :kept.shape[1]] = kept
        return out

    def _beam(self, queries: np.ndarray, entries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` nodes that each query meets on a layer, best first; -1 where there are fewer."""
        if len(queries) > AT_ONCE:
            parts = [self._beam(queries[a:a + AT_ONCE], entries[a:a + AT_ONCE], k, width) for a in range(0, len(queries), AT_ONCE)]
            return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])
        links, q = self.layers[k], len(queries)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, len(self.unit) + 1), bool)  # the last column takes what is not a node
        seen[:, -1] = True
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -np.inf)
        opened = np.ones((q, width), bool)

        def meet(found: np.ndarray) -> None:
            nonlocal ids, sims, opened
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[rows, found]] = -1
            seen[rows, found] = True
            s = np.full(found.shape, -np.inf)
            at = np.nonzero(found >= 0)  # few: most neighbours have been met
            s[at] = np.einsum("nd,nd->n", queries[at[0]], self.unit[found[at]])
            all_ids, all_sims = np.hstack([ids, found]), np.hstack([sims, s])
            all_open = np.hstack([opened, found < 0])
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids, sims, opened = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_open))

        meet(entries.astype(np.int64))
        while True:
            waiting = np.where(opened, -np.inf, sims)
            step = min(4, width)
            at = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            live = np.isfinite(np.take_along_axis(waiting, at, 1))
            if not live.any():
                break
            np.put_along_axis(opened, at, True, 1)
            nodes = np.where(live, np.take_along_axis(ids, at, 1), -1)
            found = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(q, -1)
            meet(found.astype(np.int64))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full((len(queries), 1), self.entry, np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            entries = self._beam(queries, entries, k, 8)[0]
        return self._beam(queries, entries, 0, min(width, len(self.unit)))

    def within(self, queries: np.ndarray, threshold: float, width: int) -> list[np.ndarray]:
        """For each query the nodes found at or above ``threshold``; a beam that lies above it wholly is widened."""
        out: list = [None] * len(queries)
        todo = np.arange(len(queries))
        while len(todo):
            if 4 * width > len(self.unit):  # the next beam is the whole shard
                for part in range(0, len(todo), 512):
                    rows = todo[part:part + 512]
                    for r, high in zip(rows, queries[rows] @ self.unit.T >= threshold, strict=True):
                        out[r] = np.flatnonzero(high).astype(np.int32)
                break
            rest = []
            step = max(1, min(512, 4_000_000 // (len(self.unit) + 1), 200_000 // width))
            for part in range(0, len(todo), step):
                rows = todo[part:part + step]
                ids, sims = self.search(queries[rows], width)
                for r, i, s in zip(rows, ids, sims, strict=True):
                    high = (s >= threshold) & (i >= 0)
                    if high.all():
                        rest.append(r)
                    else:
                        out[r] = i[high].astype(np.int32)
            todo, width = np.array(rest, np.int64), width * 4
        return out

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, entry=self.entry, **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return held.getvalue()

    @classmethod
    def from_bytes(cls, unit: np.ndarray, data: bytes) -> Graph:
        held = np.load(io.BytesIO(data))
        return cls(unit, [held[f"layer{k}"] for k in range(len(held.files) - 1)], int(held["entry"]))


def _units(raw: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, "<f8").reshape(-1, dim)
    # Scaled by the largest component first: squares of very large or very small components would leave the range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def audited_links(graph: Graph, queries: np.ndarray, threshold: float, width: int = BEAM) -> list[np.ndarray]:
    """Nodes near each query, with beams widened until the audit passes; a beam as wide as the shard is exhaustive."""
    slack = threshold - 1e-9
    asked = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)
    truth = queries[asked] @ graph.unit.T >= slack
    while True:
        found = graph.within(queries, slack, width)
        hits = sum(int(truth[j][found[a]].sum()) for j, a in enumerate(asked))
        if hits >= RECALL * truth.sum() or 4 * width > len(graph.unit):
            return found
        width *= 2


def block_links(graph: Graph, x: np.ndarray, asking: Graph, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors of one shard are linked to which of another (or of itself), found from either side."""
    linked = np.zeros((len(x), len(y)), bool)
    sides = [(graph, x, asking, y, linked)] + ([(asking, y, graph, x, linked.T)] if asking is not graph else [])
    for held, a, queries, b, marks in sides:
        lengths = np.linalg.norm(a, axis=1)
        for q, found in enumerate(audited_links(held, queries.unit, threshold)):
            marks[found[a[found] @ b[q] / (lengths[found] * np.linalg.norm(b[q])) >= threshold], q] = True
    if asking is graph:
        linked |= linked.T.copy()
        np.fill_diagonal(linked, False)
    return linked


def block_groups(linked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each group that the marks connect."""
    todo, out = linked.any(axis=1), []
    for start in np.flatnonzero(todo):
        if not todo[start]:
            continue
        todo[start] = False
        rows, columns, fresh = [np.array([start])], [], np.array([start])
        open_columns = np.ones(linked.shape[1], bool)
        while len(fresh):
            reached = np.flatnonzero(linked[fresh].any(axis=0) & open_columns)
            open_columns[reached] = False
            columns.append(reached)
            fresh = np.flatnonzero(linked[:, reached].any(axis=1) & todo)
            todo[fresh] = False
            rows.append(fresh)
        out.append((np.concatenate(rows), np.concatenate(columns)))
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.93, shard: int = SHARD, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    v = F.col("v")
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fit = (F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0.0))
    # Adding zero makes both zeros one, so that equal vectors have equal keys.
    v0 = F.transform(v, lambda x: x + F.lit(0.0))
    key = F.concat(F.hex(F.xxhash64("label", v0)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), v0, "label")))
    rows = given.withColumn("key", F.when(fit, key))
    nodes = written(rows.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "hnsw-nodes")
    shards = written(nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "hnsw-shards")
    dealt = nodes.join(shards, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")).select("label", "dim", "shards", "shard", "key", "copies", "v")

    def index(part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        dim = part.column("dim")[0].as_py()
        raw = np.asarray(part.column("v").combine_chunks().flatten()).astype("<f8").tobytes()
        graph = Graph.build(_units(raw, dim)[1])
        first = lambda c: [part.column(c)[0].as_py()]
        return pa.table({"label": first("label"), "dim": pa.array(first("dim"), pa.int32()), "shards": pa.array(first("shards"), pa.int32()),
                         "shard": pa.array(first("shard"), pa.int32()), "keys": pa.array([part.column("key").to_pylist()], pa.list_(pa.string())),
                         "copies": pa.array([part.column("copies").to_pylist()], pa.list_(pa.int64())),
                         "vectors": pa.array([raw], pa.binary()), "graph": pa.array([graph.to_bytes()], pa.binary())})

    packs = written(dealt.groupBy("label", "dim", "shard").applyInArrow(
        index, "label string, dim int, shards int, shard int, keys array<string>, copies array<bigint>, vectors binary, graph binary"), "hnsw-shard")
    # Each two shards of a label meet once: a shard stands once for every other one, and once for itself.
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    packed = packs.select("label", "dim", "shard", other.alias("other"), "keys", "copies", "vectors", "graph").select(
        "label", "dim", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard", "keys", "copies", "vectors", "graph")

    def meet(group: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        dim, block = group[1].as_py(), block.sort_by("shard")
        keys = [np.array(k, object) for k in block.column("keys").to_pylist()]
        copies = [np.array(c, np.int64) for c in block.column("copies").to_pylist()]
        x = [_units(v, dim) for v in block.column("vectors").to_pylist()]
        graphs = [Graph.from_bytes(unit, g) for (_, unit), g in zip(x, block.column("graph").to_pylist(), strict=True)]
        linked = block_links(graphs[0], x[0][0], graphs[-1], x[-1][0], threshold)
        sides = [(keys[0], linked @ copies[-1])] + ([(keys[-1], copies[0] @ linked)] if len(keys) > 1 else [])
        out, lowest = {}, {}
        for names, counts in sides:
            out.update((names[k], int(counts[k])) for k in np.flatnonzero(counts))
        for rows, columns in block_groups(linked):
            members = {*keys[0][rows], *keys[-1][columns]}
            lowest.update(dict.fromkeys(members, min(members)))
        return pa.table({"key": pa.array(list(out), pa.string()), "linked": pa.array(list(out.values()), pa.int64()),
                         "lowest": pa.array([lowest[k] for k in out], pa.string())})

    links = written(packed.groupBy("label", "dim", "low", "high").applyInArrow(meet, "key string, linked long, lowest string"), "hnsw-links")

    others = links.groupBy("key").agg(F.sum("linked").alias("linked"))
    parts = connected_components(links.select("key", "lowest")).withColumnRenamed("node", "key")
    placed = nodes.select("key", "copies", "id").join(others, "key", "left").join(parts, "key", "left").select(
        "key", "id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = written(placed.join(smallest, "component").select("key", "n_links", "component_id"), "hnsw-named")
    # Unfit vectors have no key; they pass the join by, or all of them would meet in one task.
    linked = rows.where("key is not null").select("id", "key").join(named, "key").select("id", "n_links", "component_id")
    apart = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(apart).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
