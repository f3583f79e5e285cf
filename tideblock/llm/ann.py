"""Approximate nearest neighbours with a robust-pruned directed graph for each shard.

Largest inner products become smallest distances: every vector gets one more
component, the root of what its squared norm lacks to the largest one, and a query
gets zero there. Points join the graph in growing batches: a greedy search proposes
neighbours, pruning with relaxed distances keeps diverse ones, and edges back are
pruned alike. Nodes that no search could reach get an edge from their nearest
reachable one. A query runs a beam search in each shard; what it meets is scored
exactly, in double precision on the original vectors. In each shard CHECKED of the
queries are also held against all its vectors; while fewer than LEAST_FOUND of their
nearest are met, the beam is doubled, up to the whole shard, so that vectors without
clusters are found as well.

Equal vectors are one node: of each, the smallest ids are kept as far as a result
can hold them, counted before anything is shuffled, so a vector that fills a third
of the table costs one node. Equal queries are searched once.

Vectors that are null, zero or hold null or non-finite components, and rows without
an id, take no part; rows repeated with id and vector count once. Vectors of
different lengths are searched apart. With fewer candidates than `k`
all are returned, an empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS, GROUP_QUERIES = 8192, 8192
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 128, 1.2
BATCH, EXPANDED = 256, 4
#: Queries of a shard that are held against all its vectors, and the share of their nearest that the beam must meet.
CHECKED, LEAST_FOUND = 64, 0.95


def _distances(points: np.ndarray, norms: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query (a row) from its own list of ids, without the query's norm; infinite for -1."""
    d = norms[ids] - 2 * np.einsum("bcd,bd->bc", points[ids], queries)
    return np.where(ids < 0, np.float32(np.inf), d)


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the best `beam` nodes met from `entry` on, nearest first, -1 where there are fewer; all queries in step."""
    n = len(queries)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(points) + 1), bool)  # the last column is that of -1
    seen[:, [entry, -1]] = True
    ids = np.full((n, beam), -1, np.int32)
    ids[:, 0] = entry
    dist = _distances(points, norms, ids, queries)
    done = ids < 0
    while not done.all():
        # the nearest few that have not been expanded
        pick = np.argsort(np.where(done, np.float32(np.inf), dist), axis=1, kind="stable")[:, :EXPANDED]
        chosen = np.where(done[rows, pick], -1, ids[rows, pick])
        done[rows, pick] = True
        near = np.where(chosen[:, :, None] < 0, -1, graph[chosen]).reshape(n, -1)
        near = np.where(seen[rows, near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[rows, near] = True
        if not (near >= 0).any():
            continue
        width = int((near >= 0).sum(axis=1).max())
        near = np.sort(near, axis=1)[:, -width:]  # what is -1 stands first
        new = _distances(points, norms, near, queries)
        every, far = np.concatenate((ids, near), axis=1), np.concatenate((dist, new), axis=1)
        flags = np.concatenate((done, near < 0), axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, dist, done = every[rows, order], far[rows, order], flags[rows, order]
    return ids, dist


def prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each owner, up to `degree` of its candidates (-1: none): the nearest first, dropping those that a chosen one is nearer to by the factor alpha."""
    n = len(owners)
    rows = np.arange(n)
    own = points[owners]
    d = ((points[candidates] - own[:, None, :]) ** 2).sum(axis=2)
    d[(candidates < 0) | (candidates == owners[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    vectors = points[candidates]
    norms = (vectors**2).sum(axis=2)
    out = np.full((n, degree), -1, np.int32)
    for k in range(degree):
        first = np.argmin(d, axis=1)
        alive = np.isfinite(d[rows, first])
        if not alive.any():
            break
        out[:, k] = np.where(alive, candidates[rows, first], -1)
        v = vectors[rows, first]
        between = np.maximum(norms + norms[rows, first][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, v), 0)
        d[(alpha * alpha * between <= d) & alive[:, None]] = np.inf
        d[rows, first] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """Neighbours of each point (-1: none) and the entry point."""
    n = len(points)
    norms = (points**2).sum(axis=1)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    rest = np.random.default_rng(seed).permutation(np.delete(np.arange(n), entry)).astype(np.int32)
    at, size = 0, 1
    while at < len(rest):
        batch = rest[at : at + size]
        at += len(batch)
        size = min(BATCH, 2 * size)
        found, _ = beam_search(points, norms, graph, entry, points[batch], beam)
        if len(batch) > 1:  # those that join together may be neighbours as well
            found = np.concatenate((found, np.broadcast_to(batch, (len(batch), len(batch)))), axis=1)
        graph[batch] = prune(points, batch, found, degree, alpha)
        # edges back, all those of a node at once
        to = graph[batch].ravel()
        back = np.repeat(batch, degree)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(nodes), int(counts.max())), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), counts), np.arange(len(to)) - np.repeat(starts, counts)] = back
        joined = np.concatenate((graph[nodes], more), axis=1)
        joined.sort(axis=1)
        joined[:, 1:][joined[:, 1:] == joined[:, :-1]] = -1
        joined = -np.sort(-joined, axis=1)
        fits = (joined >= 0).sum(axis=1) <= degree
        graph[nodes[fits]] = joined[fits][:, :degree]
        if (~fits).any():
            graph[nodes[~fits]] = prune(points, nodes[~fits].astype(np.int32), joined[~fits], degree, alpha)
    return connect(points, norms, graph, entry, beam), entry


def reached(graph: np.ndarray, entry: int) -> np.ndarray:
    seen = np.zeros(len(graph), bool)
    seen[entry] = True
    front = np.array([entry])
    while len(front):
        front = np.unique(graph[front])
        front = front[front >= 0]
        front = front[~seen[front]]
        seen[front] = True
    return seen


def connect(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """Give each node that cannot be reached an edge from the nearest that can, in a column of its own if need be."""
    while len(lost := np.flatnonzero(~reached(graph, entry))):
        node = lost[:1]
        near = int(beam_search(points, norms, graph, entry, points[node], beam)[0][0, 0])
        free = np.flatnonzero(graph[near] < 0)
        if not len(free):
            graph = np.concatenate((graph, np.full((len(graph), 1), -1, np.int32)), axis=1)
            free = [graph.shape[1] - 1]
        graph[near, free[0]] = node[0]
    return graph


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vector: str) -> str:
    """SQL condition: all components there and finite, and not all zero."""
    return f"{vector} IS NOT NULL AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists({vector}, x -> x != 0)"


def build_index(vectors: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """A row for each shard: dim, shard, n_shards of its dimension, and the parts of its graph. vectors are usable."""
    copies = Window.partitionBy(vec_col).orderBy(id_col)
    few = vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col).withColumn("_nth", F.dense_rank().over(copies)).filter(F.col("_nth") <= k + 1)
    nodes = written(few.groupBy(F.col(vec_col).alias("vector")).agg(F.array_sort(F.collect_set(id_col)).alias("ids")).withColumn("dim", F.size("vector")), "vectors")
    sizes = {r["dim"]: (r["n"], r["top"]) for r in nodes.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.expr("aggregate(vector, 0D, (a, x) -> a + double(x) * double(x))")).alias("top")).collect()}  # a row for each length of vectors
    counts = F.create_map(*[F.lit(x) for d, (n, _) in sizes.items() for x in (d, -(-n // SHARD_ROWS))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    sharded = nodes.withColumn("n_shards", counts[F.col("dim")]).withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("n_shards")).cast("int"))

    def make(key, table):
        dim, shard, n_shards = (x.as_py() for x in key)
        order = np.argsort([x[0] for x in table.column("ids").to_pylist()], kind="stable")
        table = table.take(pa.array(order))
        vectors = _matrix(table.column("vector"))
        lack = np.sqrt(np.maximum(sizes[dim][1] - (vectors**2).sum(axis=1), 0))
        points = np.column_stack((vectors, lack)).astype(np.float32)
        graph, entry = build(points)
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_shards": pa.array([n_shards], pa.int32()), "entry": pa.array([entry], pa.int32()), "degree": pa.array([graph.shape[1]], pa.int32()),
                "vectors": pa.array([vectors.tobytes()], pa.binary()), "points": pa.array([points.tobytes()], pa.binary()), "graph": pa.array([graph.tobytes()], pa.binary()),
                "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            }
        )

    made = "dim int, shard int, n_shards int, entry int, degree int, vectors binary, points binary, graph binary, ids array<array<bigint>>"
    return written(sharded.select("dim", "shard", "n_shards", "vector", "ids").groupBy("dim", "shard", "n_shards").applyInArrow(make, made), "index")


def wide_enough(own: np.ndarray, points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, wanted: np.ndarray, scaled: np.ndarray, k: int, beam: int) -> int:
    """The beam, doubled until searches meet LEAST_FOUND of the k largest inner products of CHECKED queries spread over `wanted`; `scaled` are the queries as the graph takes them."""
    picked = np.unique(np.linspace(0, len(wanted) - 1, min(CHECKED, len(wanted))).astype(int))
    scores = wanted[picked] @ own.T
    k = min(k, len(own))
    least = np.partition(scores, -k, axis=1)[:, -k]
    while beam < len(own):
        met, _ = beam_search(points, norms, graph, entry, scaled[picked], beam)
        found = (met >= 0) & (np.take_along_axis(scores, np.maximum(met, 0), 1) >= least[:, None])
        if np.minimum(found.sum(axis=1), k).mean() >= LEAST_FOUND * k:
            break
        beam *= 2
    return beam


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank from 1, id and score of the k largest inner products found for each usable row of queries, its own id left out; ties go to smaller ids."""
    index = build_index(vectors.filter(usable(vec_col)).filter(F.col(id_col).isNotNull()), k, id_col, vec_col)
    asked = queries.filter(usable(vec_col)).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("vector")).distinct()
    distinct = written(asked.groupBy("vector").agg(F.min("query_id").alias("asked")).withColumn("dim", F.size("vector")), "queries")
    groups = max(1, -(-distinct.count() // GROUP_QUERIES))
    shards = index.select("dim", "n_shards").distinct()  # a row for each length of vectors
    ask = (
        distinct.withColumn("group", F.pmod(F.xxhash64("asked"), F.lit(groups)).cast("int"))
        .join(F.broadcast(shards), "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)))
        .select("dim", "shard", "group", "asked", "vector")
    )
    graphs = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def find(left, right):
        out = {"asked": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            r = {c: left.column(c)[0].as_py() for c in left.column_names}
            own = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"])
            points = np.frombuffer(r["points"], np.float32).reshape(-1, r["dim"] + 1)
            graph = np.frombuffer(r["graph"], np.int32).reshape(-1, r["degree"])
            norms, ids, names = (points**2).sum(axis=1), r["ids"], right.column("asked").to_pylist()
            wanted = _matrix(right.column("vector"))
            # a query's scale changes no order of inner products; at the points' scale distances keep their digits
            unit = wanted / np.sqrt((wanted**2).sum(axis=1, keepdims=True)) * np.sqrt(max(1e-300, float(norms.max())))
            scaled = np.column_stack((unit, np.zeros(len(wanted)))).astype(np.float32)
            width = wide_enough(own, points, norms, graph, r["entry"], wanted, scaled, k + 1, max(beam, 2 * (k + 1)))
            for s in range(0, len(wanted), BATCH):
                q = wanted[s : s + BATCH]
                met, _ = beam_search(points, norms, graph, r["entry"], scaled[s : s + BATCH], width)
                for i, row in enumerate(met):
                    row = row[row >= 0]
                    score = own[row] @ q[i]
                    order, taken = np.lexsort((row, -score)).tolist(), 0
                    for n, j in enumerate(order):  # nodes are numbered by their smallest ids
                        if taken > k and score[j] < score[order[n - 1]]:
                            break  # equal scores stay together, so that ids decide among them
                        own_ids = ids[row[j]]
                        out["asked"] += [names[s + i]] * len(own_ids)
                        out["id"] += own_ids
                        out["score"] += [float(score[j])] * len(own_ids)
                        taken += len(own_ids)
        return pa.table({"asked": pa.array(out["asked"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    key = ["dim", "shard", "group"]
    found = graphs.groupBy(*key).cogroup(ask.groupBy(*key)).applyInArrow(find, "asked long, id long, score double")
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= k + 1).select("asked", "id", "score")
    rows = asked.join(distinct.select("vector", "asked"), "vector").select("query_id", "asked").join(best, "asked").filter("id != query_id")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "id")
    return rows.select("query_id", F.row_number().over(order).alias("rank"), F.col("id").alias(id_col), "score").filter(F.col("rank") <= k)
