"""Approximate nearest neighbours: a robust-pruned directed graph for each shard of vectors, searched by beams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored

NONE = -1
#: Queries that are searched in step, and numbers that a step of pruning may hold.
LANES, ROOM = 512, 4_000_000


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """vectors around their mean and within 1, in single precision, for comparisons; the mean and the scale."""
    centre = vectors.mean(axis=0)
    scale = float(np.abs(vectors - centre).max()) or 1.0
    return ((vectors - centre) / scale).astype(np.float32), centre, scale


def _squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, d) to others (n, m, d), from differences, so that near ones keep their digits."""
    gap = others - points[:, None, :]
    return np.einsum("nmd,nmd->nm", gap, gap)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, wanted: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of wanted (at most LANES) the beam nearest points found, nearest first, their squared distances, and how many there are.

    From entry, the nearest point not yet looked at hands over its neighbours, until all of the beam are looked
    at. All rows of wanted go in step.
    """
    q, width = len(wanted), graph.shape[1]
    at = np.full((q, beam), NONE, np.int32)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, len(points) + 1), bool)  # the last column stands for NONE
    seen[:, NONE] = True
    at[:, 0], far[:, 0], done[:, 0], seen[:, entry] = entry, _squared(wanted, points[None, [entry]].repeat(q, 0))[:, 0], False, True
    rows = np.arange(q)
    while len(rows):
        spot = np.argmin(done[rows], axis=1)  # lists are sorted, so the first not done is the nearest
        done[rows, spot] = True
        next_to = graph[at[rows, spot]]
        fresh = ~seen[rows[:, None], next_to]
        seen[rows[:, None], next_to] = True
        away = np.where(fresh, _squared(wanted[rows], points[next_to]), np.inf).astype(np.float32)
        all_far = np.concatenate([far[rows], away], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        at[rows] = np.take_along_axis(np.concatenate([at[rows], next_to], axis=1), best, axis=1)
        far[rows] = np.take_along_axis(all_far, best, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros((len(rows), width), bool)], axis=1), best, axis=1) | np.isinf(far[rows])
        rows = rows[~done[rows].all(axis=1)]
    return at, far, np.isfinite(far).sum(axis=1)


def robust_prune(points: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The edges (n, degree) that each of own keeps of its candidates near (n, m; NONE: no candidate).

    Again and again the nearest candidate left is kept, and all go that are alpha times nearer to it than to own.
    """
    out = np.full((len(own), degree), NONE, np.int32)
    step = max(1, ROOM // (near.shape[1] ** 2 + near.shape[1] * points.shape[1]))
    for a in range(0, len(own), step):
        mine, cand = own[a : a + step], near[a : a + step]
        away = np.where((cand == NONE) | (cand == mine[:, None]), np.inf, _squared(points[mine], points[cand]))
        order = np.argsort(away, axis=1, kind="stable")
        cand, away = np.take_along_axis(cand, order, axis=1), np.take_along_axis(away, order, axis=1)
        held = points[cand]
        norms = np.einsum("nmd,nmd->nm", held, held)
        between = norms[:, :, None] + norms[:, None, :] - 2 * held @ held.transpose(0, 2, 1)
        left = np.isfinite(away)
        rows = np.arange(len(mine))
        for k in range(degree):
            rows = rows[left[rows].any(axis=1)]
            if not len(rows):
                break
            best = np.argmax(left[rows], axis=1)
            out[a + rows, k] = cand[rows, best]
            left[rows] &= alpha * alpha * between[rows, best] > away[rows]
            left[rows, best] = False
            # A repeated candidate is no second edge.
            left[rows] &= cand[rows] != cand[rows, best][:, None]
    return out


def build_graph(points: np.ndarray, degree: int = 48, beam: int = 64, alpha: float = 1.2, seed: int = 12) -> tuple[np.ndarray, int]:
    """(graph, entry) of points: each one's edges, as many as degree at most and a few to keep all within reach; NONE fills up.

    Points come in batches that double up to LANES. A beam search through the graph so far proposes each one's
    neighbours, robust_prune chooses, and the chosen ones get an edge back, pruned again where they have too many.
    """
    n = len(points)
    graph = np.full((n, degree), NONE, np.int32)
    entry = int(np.argmin(np.einsum("nd,nd->n", points, points)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(at, LANES)]
        found, _, _ = beam_search(points, graph, entry, points[batch], beam)
        graph[batch] = robust_prune(points, batch, found, degree, alpha)
        _add_back(points, graph, batch, degree, alpha)
        at += len(batch)
    return _reach_all(graph, entry), entry


def _add_back(points: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    to, back = graph[batch].ravel(), np.repeat(batch, degree)
    to, back = to[to != NONE], back[to != NONE]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first, times = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, times)
    # Nodes with few new edges and those with many are handled apart, so that none is padded to the longest.
    for low, high in ((0, degree), (degree, len(to) + 1)):
        some = (times > low) & (times <= high)
        if some.any():
            new = np.full((int(some.sum()), int(times[some].max())), NONE, np.int32)
            picked = np.repeat(some, times)
            new[np.repeat(np.arange(int(some.sum())), times[some]), place[picked]] = back[picked]
            near = np.concatenate([graph[nodes[some]], new], axis=1)
            full = (near != NONE).sum(axis=1) > degree
            if full.any():
                graph[nodes[some][full]] = robust_prune(points, nodes[some][full], near[full], degree, alpha)
            room = np.sort(near[~full], axis=1)[:, ::-1][:, :degree]  # NONE is smallest
            graph[nodes[some][~full]] = np.pad(room, ((0, 0), (0, degree - room.shape[1])), constant_values=NONE)


def _reach_all(graph: np.ndarray, entry: int) -> np.ndarray:
    """graph with further columns where some points cannot be reached: each gets an edge from the nearest of its own neighbours that can."""
    while True:
        reached = np.zeros(len(graph), bool)
        reached[entry], front = True, np.array([entry])
        while len(front):
            front = np.unique(graph[front])
            front = front[(front != NONE) & ~reached[front]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return graph
        graph = np.pad(graph, ((0, 0), (0, 1)), constant_values=NONE)
        taken = set()
        for u in lost.tolist():
            hosts = [v for v in graph[u].tolist() if v != NONE and reached[v] and v not in taken] or ([entry] if entry not in taken else [])
            if hosts:
                graph[hosts[0], -1] = u
                taken.add(hosts[0])


# In Spark.


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(rows: DataFrame, per_vector: int, shard_size: int = 8192, degree: int = 48, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """(dims, entry, n, width, vectors, graph, ids) of rows (vec_id, vector: doubles): one row for each shard.

    Equal vectors are one point, which has its per_vector smallest ids; no answer of per_vector rows holds more of
    them. Points are dealt by a hash into shards of about shard_size, of one number of dimensions each.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    points = stored(rows.withColumn("_rank", rank).where(F.col("_rank") <= per_vector).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    shards = max(1, -(-points.count() // shard_size))
    dealt = points.select(F.size("vector").alias("dims"), F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"), "vector", "ids", F.col("ids")[0].alias("first"), F.hash("vector").alias("tie"))
    schema = "dims int, entry int, n int, width int, vectors binary, graph binary, ids array<array<long>>"

    def built(key, table):
        # Points come in the order of the shuffle; sorted, a shard has the same graph in every run.
        table = table.sort_by([("first", "ascending"), ("tie", "ascending")])
        dims, n = key[0].as_py(), len(table)
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(n, dims)
        graph, entry = build_graph(scaled(vectors)[0], degree, beam, alpha)
        numbers = {c: pa.array([v], pa.int32()) for c, v in (("dims", dims), ("entry", entry), ("n", n), ("width", graph.shape[1]))}
        ids = pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.table(numbers | {"vectors": [vectors.tobytes()], "graph": [graph.tobytes()], "ids": ids})

    return stored(dealt.groupBy("dims", "shard").applyInArrow(built, schema), "graphs")


def _search_shard(shard: dict, spots: np.ndarray, own_ids: np.ndarray, asked: np.ndarray, k: int, beam: int) -> list[tuple[int, int, int, float]]:
    """(spot, query_id, vec_id, score) of the k nearest of one shard for each query asked (q, dims), scored in double precision."""
    n, dims = shard["n"], shard["dims"]
    vectors = np.frombuffer(shard["vectors"], np.float64).reshape(n, dims)
    graph = np.frombuffer(shard["graph"], np.int32).reshape(n, shard["width"])
    points, centre, scale = scaled(vectors)
    out = []
    for a in range(0, len(asked), LANES):
        block = asked[a : a + LANES]
        found, _, counts = beam_search(points, graph, shard["entry"], ((block - centre) / scale).astype(np.float32), max(beam, k + 1))
        gap = vectors[found] - block[:, None, :]
        scores = np.sqrt((gap * gap).sum(axis=2))
        for i, count in enumerate(counts.tolist()):
            own, rows = int(own_ids[a + i]), []
            for j in np.argsort(scores[i, :count], kind="stable")[: k + 1].tolist():
                rows += [(float(scores[i, j]), x) for x in shard["ids"][found[i, j]] if x != own]
            out += [(int(spots[a + i]), own, x, score) for score, x in sorted(rows)[:k]]
    return out


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = 128, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (query_id, vector: doubles): the k nearest that beam searches of every shard find.

    Blocks of `block` queries at most are sent to the shards of their number of dimensions, so that what is
    broadcast has a bound; each shard answers with k rows a query, and the best k of all are kept.
    """
    asked = stored(queries.select(F.monotonically_increasing_id().alias("spot"), "query_id", "vector"), "asked")
    blocks = max(1, -(-asked.count() // block))
    out_schema = "spot long, query_id long, vec_id long, score double"

    def answered(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                q = len(shard["spots"])
                found = _search_shard(shard, np.array(shard["spots"]), np.array(shard["own"]), np.frombuffer(shard["asked"], np.float64).reshape(q, shard["dims"]), k, beam)
                columns = list(zip(*found, strict=True)) if found else [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["spot", "query_id", "vec_id", "score"])

    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("spot"), F.lit(blocks)) == b)
        packed = part.groupBy(F.size("vector").alias("dims")).agg(F.collect_list(F.struct("spot", "query_id", "vector")).alias("q"))
        packed = packed.select("dims", F.col("q.spot").alias("spots"), F.col("q.query_id").alias("own"), _bytes_of("q.vector").alias("asked"))
        one = index.join(F.broadcast(packed), "dims").mapInArrow(answered, out_schema)
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(Window.partitionBy("spot", "query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bytes_of(vectors: str) -> Column:
    """Vectors one after the other, as bytes."""

    @F.pandas_udf("binary")
    def packed(columns):
        return columns.map(lambda rows: np.concatenate([np.asarray(r, np.float64) for r in rows]).tobytes())

    return packed(F.col(vectors))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, column: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors (vec_id, column) for those whose vec_id `every` divides.

    score: Euclidean distance in double precision of the vectors as they are; of equal ones the smaller vec_id is
    first. A query is never its own candidate. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do rows without a vec_id; only vectors of as many dimensions are compared. Equal rows count
    once; different vectors of one vec_id are rows of their own, but no candidates for each other. If there are
    fewer than k candidates all are returned. An empty table gives an empty one. Other columns, whatever their
    names, are neither read nor returned. options: shard_size, degree, beam and alpha of the graphs, search_beam.
    """
    search_beam = options.pop("search_beam", 128)
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()
    rows = stored(rows, "vectors")
    index = build_index(rows, k + 1, **options)
    return search(index, rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector"), k, search_beam)
