"""The graph's answers against brute force: exact where everything is in reach of a beam, else by recall."""

import math

import numpy as np
import pytest

from quillspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, vector string, ids int, spot int, dims string, rank int, query_id string"
EXTRA = [1, "v", 2, 3, "d", 4, "q"]
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    fit = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in fit:
        if i % every == 0:
            scored = sorted((float(np.sqrt(((np.array(q) - np.array(v)) ** 2).sum())), j) for j, v in fit if j != i and len(v) == len(q))
            out.setdefault(i, []).append([(rank, j, score) for rank, (score, j) in enumerate(scored[:k], 1)])
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(v) for i, v in out.items()}


def awkward():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    hot = [1.0, -0.0, 2.0, 0.0, 0.5, 0.25]
    rows += [(i, hot if i % 2 else [x + 0.0 for x in hot]) for i in range(1000, 1400)]
    rows += [(5000, None), (5100, []), (5200, [0.0] * 6), (5300, [NAN] + [1.0] * 5), (5400, [INF] + [1.0] * 5), (5500, [None] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(6000, [1.0, 2.0]), (6001, [1.0, 3.0]), (6002, [1.0, 1.0]), rows[100], rows[100], (7, rows[8][1])]
    return rows


@pytest.mark.parametrize("shard_size", [200, 8192])
def test_awkward_rows_ties_and_hot_vectors(spark, shard_size):
    rows = awkward()
    found = answers(neighbours.nearest(table(spark, rows), shard_size=shard_size, search_beam=400))
    wanted = {i: v[0] for i, v in brute(rows).items()}
    assert set(found) == set(wanted) and len(found[6000]) == 2
    for i, own in wanted.items():
        assert [(r, j) for r, j, _ in found[i]] == [(r, j) for r, j, _ in own]
        assert np.allclose([s for *_, s in found[i]], [s for *_, s in own], rtol=1e-14, atol=0)


def test_few_rows(spark):
    assert neighbours.nearest(table(spark, [])).count() == 0
    assert neighbours.nearest(table(spark, [(100, [1.0, 2.0])])).count() == 0
    assert neighbours.nearest(table(spark, [(1, [1.0, 2.0]), (3, [2.0, 2.0])])).count() == 0
    assert answers(neighbours.nearest(table(spark, [(100, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 8.0])]))) == {100: [(1, 1, 0.0), (2, 2, 5.0)]}


def test_recall_over_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in vectors.collect()]
    found = answers(neighbours.nearest(vectors, shard_size=700, every=20))
    wanted = {i: v[0] for i, v in brute(rows, every=20).items()}
    assert set(found) == set(wanted) and all([r for r, *_ in v] == list(range(1, 11)) for v in found.values())
    hit = sum(len({j for _, j, _ in found[i]} & {j for _, j, _ in own}) for i, own in wanted.items())
    assert hit / sum(map(len, wanted.values())) >= 0.98


def test_blocks_of_queries_change_nothing(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", neighbours.F.col("embedding").cast("array<double>").alias("vector"))
    index = neighbours.build_index(vectors, 11, shard_size=150)
    queries = vectors.where("vec_id % 10 = 0").select(neighbours.F.col("vec_id").alias("query_id"), "vector")
    assert answers(neighbours.search(index, queries, 10)) == answers(neighbours.search(index, queries, 10, block=9))


def slow_prune(points, own, near, degree, alpha):
    left = sorted({c for c in near if c not in (own, neighbours.NONE)}, key=lambda c: ((points[c] - points[own]) ** 2).sum())
    kept = []
    while left and len(kept) < degree:
        kept.append(left[0])
        left = [c for c in left[1:] if alpha * np.linalg.norm(points[c] - points[kept[-1]]) > np.linalg.norm(points[c] - points[own])]
    return kept


def test_pruning_keeps_diverse_edges():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 3)).astype(np.float32)
    own = np.arange(0, 60)
    near = rng.integers(0, 300, size=(60, 40)).astype(np.int32)
    near[:, :3] = neighbours.NONE
    for degree, alpha in ((6, 1.2), (30, 1.0)):
        found = neighbours.robust_prune(points, own, near, degree, alpha)
        for p, row, candidates in zip(own, found, near, strict=True):
            assert [x for x in row.tolist() if x != neighbours.NONE] == slow_prune(points, p, candidates.tolist(), degree, alpha)


def test_every_point_is_in_reach():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 50
    points = neighbours.scaled(np.repeat(centres, 80, axis=0) + rng.normal(size=(960, 8)))[0]
    graph, entry = neighbours.build_graph(points, degree=8, beam=12)
    reached, front = {entry}, [entry]
    while front:
        front = [v for u in front for v in graph[u].tolist() if v != neighbours.NONE and v not in reached and not reached.add(v)]
    assert len(reached) == len(points)
    assert all(len(set(r)) == len(r) and i not in r for i, r in enumerate([[v for v in row if v != neighbours.NONE] for row in graph[:, :8].tolist()]))
