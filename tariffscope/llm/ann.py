"""Nearest neighbours by inner product, over robust-pruned directed graphs.

Distinct vectors are dealt to shards of about ``SHARD`` by hash, and each shard's graph is built in one task. Nodes
are inserted in batches: a greedy search from the shard's entry points proposes neighbours, and relaxed pruning keeps a near
one unless a neighbour already kept is nearer to it by the factor ``ALPHA``; edges are added in both directions and
pruned again where they exceed ``DEGREE``. Inner products become distances by one more coordinate that
gives all vectors of a shard the same length.

A query is searched by a beam in every shard of its dimension, in blocks of queries, and the best of all shards
are its answer. Scores are computed anew in double precision on the original vectors.

Equal vectors are one node that carries its smallest ids, one more than are asked for, so a vector that
a third of all rows share is one node too.

Defined results: vectors that are null, empty, zero, or hold nulls or components that are not finite take no
part, nor do rows without an id; a query's own id is never its neighbour; of vectors of several dimensions, each
meets only its own; rows that repeat an id and vector are one; an id with several vectors is one neighbour and one query, by
the best score of any of them; empty tables give an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch

SHARD, DEGREE, ALPHA = 8192, 32, 1.2
BUILD_BEAM, SEARCH_BEAM = 64, 192
BATCH, ENTRIES, QUERY_BLOCK = 512, 16, 512


def search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int):
    """The ``beam`` nodes nearest to each query that a beam search finds (-1 for none), with their squared distances,
    nearest first. ``graph`` has a row of neighbours per node, -1 where there are fewer."""
    rows, n = len(queries), len(vectors)
    norms = np.einsum("ij,ij->i", vectors, vectors)

    def distances(nodes):
        dots = np.einsum("ijk,ik->ij", vectors[nodes], queries)
        return np.where(nodes >= 0, norms[nodes] - 2 * dots, np.inf)

    seen = np.zeros((rows, n + 1), bool)
    nodes = np.full((rows, beam), -1, np.int64)
    start = min(beam, len(entries))
    nodes[:, :start] = entries[:start]
    seen[:, entries[:start]] = True
    seen[:, n] = True
    dist = distances(nodes)
    open_ = nodes >= 0
    each = np.arange(rows)
    while True:
        waiting = np.where(open_, dist, np.inf)
        pick = waiting.argmin(axis=1)
        active = np.flatnonzero(np.isfinite(waiting[each, pick]))
        if not len(active):
            break
        open_[active, pick[active]] = False
        near = graph[nodes[active, pick[active]]]
        fresh = ~seen[active[:, None], near]
        near = np.where(fresh, near, -1)
        seen[active[:, None], near] = True
        dots = np.einsum("ijk,ik->ij", vectors[near], queries[active])
        found = np.where(near >= 0, norms[near] - 2 * dots, np.inf)
        every = np.concatenate([dist[active], found], axis=1)
        best = np.argpartition(every, beam - 1, axis=1)[:, :beam]
        dist[active] = np.take_along_axis(every, best, 1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], near], axis=1), best, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], near >= 0], axis=1), best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
    nodes[~np.isfinite(dist)] = -1
    return nodes, dist + np.einsum("ij,ij->i", queries, queries)[:, None]


def prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """DEGREE neighbours for each of ``points`` out of its row of candidates (-1 for none)."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = -np.sort(-candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    near = vectors[candidates]
    gap = near - vectors[points][:, None, :]
    dist = np.where(candidates >= 0, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
    kept = np.full((len(points), DEGREE), -1, np.int64)
    each = np.arange(len(points))
    for k in range(DEGREE):
        pick = dist.argmin(axis=1)
        left = np.isfinite(dist[each, pick])
        if not left.any():
            break
        kept[left, k] = candidates[each, pick][left]
        gap = near - near[each, pick][:, None, :]
        between = np.einsum("ijk,ijk->ij", gap, gap)
        dist[ALPHA * ALPHA * between <= dist] = np.inf
        dist[each, pick] = np.inf
    return kept


def build(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A graph over ``vectors``, as a row of neighbours per node, and its entry points."""
    n = len(vectors)
    draw = np.random.Generator(np.random.PCG64(seed))
    middle = ((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin()
    entries = np.unique(np.concatenate([[middle], draw.choice(n, min(n, ENTRIES) - 1, replace=False)]))
    graph = np.full((n, DEGREE), -1, np.int64)
    order = draw.permutation(n)
    size, done = 32, 0  # the first batches are small: they find little to link to
    while done < n:
        batch = order[done : done + size]
        done += len(batch)
        size = min(BATCH, 2 * size)
        found, _ = search(vectors, graph, entries, vectors[batch], BUILD_BEAM)
        mates = np.broadcast_to(batch[: DEGREE // 2], (len(batch), len(batch[: DEGREE // 2])))
        graph[batch] = prune(vectors, batch, np.concatenate([found, graph[batch], mates], axis=1))
        # The other direction: what new nodes chose gets an edge back.
        source, target = np.repeat(batch, DEGREE), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        points, first, times = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(points), min(times.max(initial=0), 2 * DEGREE)), -1, np.int64)
        nth = np.arange(len(target)) - np.repeat(first, times)
        which = np.repeat(np.arange(len(points)), times)
        fits = nth < back.shape[1]
        back[which[fits], nth[fits]] = source[fits]
        for at in range(0, len(points), BATCH):
            part = points[at : at + BATCH]
            graph[part] = prune(vectors, part, np.concatenate([graph[part], back[at : at + BATCH]], axis=1))
    return graph, entries


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate that makes all of them as long as the longest."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.column_stack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))])


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and ``vector``, the bytes of its 32-bit floats, of rows that take part."""
    for batch in batches:
        ids, made = [], []
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector")):
            if vec_id is None or not vector.is_valid or not len(vector.values) or vector.values.null_count:
                continue
            values = vector.values.to_numpy(zero_copy_only=False)
            if np.isfinite(values).all() and values.any():
                ids.append(vec_id)
                made.append((values + 0).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["vec_id", "vector"])


def _smallest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per task: each distinct vector with its k smallest ids."""
    for batch in batches:
        found: dict[bytes, list[int]] = {}
        for vec_id, vector in sorted(zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist())):
            ids = found.setdefault(vector, [])
            if len(ids) < k and (not ids or ids[-1] != vec_id):
                ids.append(vec_id)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["vector", "ids"]
        )


def _graphs(key, rows):
    vectors = np.stack([np.frombuffer(v, "<f8") for v in rows.column("vector").to_pylist()])
    graph, entries = build(lengthened(vectors).astype(np.float32))
    return pa.table({
        "dim": pa.array([vectors.shape[1]], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()),
        "vectors": pa.array([vectors.tobytes()], pa.binary()), "ids": pa.array([rows.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
        "graph": pa.array([graph.astype("<i4").tobytes()], pa.binary()), "entries": pa.array([entries.tolist()], pa.list_(pa.int64())),
    })


def index(embeddings: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """A row per shard: its distinct vectors, their ids, and its graph."""
    distinct = scratch.keep(
        embeddings.mapInArrow(lambda batches: _smallest(batches, k + 1), "vector binary, ids array<long>")
        .groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
        .withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "distinct",
    )
    shards = max(1, -(-distinct.count() // SHARD))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    return scratch.keep(
        dealt.groupBy("dim", "shard").applyInArrow(
            _graphs, "dim int, shard long, vectors binary, ids array<array<long>>, graph binary, entries array<long>"
        ),
        "index",
    )


def _answers(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
            graph = np.frombuffer(row["graph"], "<i4").reshape(-1, DEGREE).astype(np.int64)
            queries = np.frombuffer(b"".join(row["queries"]), "<f8").reshape(-1, dim)
            long = lengthened(vectors).astype(np.float32)
            asked = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
            width = min(beam, len(vectors))
            found, _ = search(long, graph, np.asarray(row["entries"]), asked, width)
            out = ([], [], [])
            for query_id, query, nodes in zip(row["query_ids"], queries, found):
                nodes = nodes[nodes >= 0]
                scores = vectors[nodes] @ query
                best = []
                for score, node in zip(scores.tolist(), nodes.tolist()):
                    best += [(-score, vec_id) for vec_id in row["ids"][node] if vec_id != query_id]
                for score, vec_id in sorted(best)[:k]:
                    out[0].append(query_id)
                    out[1].append(vec_id)
                    out[2].append(-score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                ["query_id", "vec_id", "score"],
            )


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of ``embeddings`` (vec_id, vector) with the largest inner
    products found for each of ``queries`` (vec_id, vector)."""
    scratch = Scratch(embeddings.sparkSession, "ann")

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
        return rows.mapInArrow(_usable, "vec_id long, vector binary")

    shards = index(usable(embeddings), k, scratch)
    asked = scratch.keep(usable(queries).distinct().withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    blocked = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))).groupBy("dim", "block")
        .agg(F.collect_list(F.struct("vec_id", "vector")).alias("q"))
        .select("dim", F.col("q.vec_id").alias("query_ids"), F.col("q.vector").alias("queries"))
    )
    # Each block meets each shard: the stated queries against all rows.
    pairs = scratch.keep(blocked, "blocks").join(shards, "dim")
    found = scratch.keep(
        pairs.repartition(max(1, blocks * shards.count()), F.xxhash64("shard", "query_ids"))
        .mapInArrow(lambda batches: _answers(batches, k, beam), "query_id long, vec_id long, score double"), "answers",
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
