"""The vector index against the exact scan, and what it reads of clustered vectors."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.embedding import dot, normalise
from quillspark.operators import retrieval, vectors
from quillspark.streaming.usage import keeper


def clustered(rng, n, dims=12, clusters=20):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [x + rng.gauss(0, 0.05) for x in centres[i % clusters]]) for i in range(n)]


def rows_of(df):
    return sorted((r["query_id"], r["pos"], r["key"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"piece_rows": 15, "max_lists": 9, "sample_rows": 60}])
def test_the_index_gives_the_scan(spark, tmp_path, options):
    rng = random.Random(2)
    data = clustered(rng, 600) + [(700 + i, [1.0] * 12) for i in range(80)] + [(900, [0.0] * 12), (901, None)]
    table = spark.createDataFrame(data, "key long, vector array<double>")
    asked = table.where("key % 11 = 0 OR key >= 778").select(F.col("key").alias("query_id"), "vector").unionByName(spark.createDataFrame([(5000, [rng.gauss(0, 1) for _ in range(12)])], "query_id long, vector array<double>"))
    index = vectors.build_index(table, "key", f"{tmp_path}/index", **options)
    found, reads = vectors.search_index(index, asked, 7, keeper(spark), first=2, block=10)
    directed = table.where(F.exists("vector", lambda x: x != 0))
    want = retrieval.vector_search(asked.where(F.exists("vector", lambda x: x != 0)), directed, "key", 7)
    assert rows_of(found) == rows_of(want)
    assert 0 < vectors.share_read(index, reads) < 0.75
    if not options:
        assert vectors.share_read(index, reads) < 0.35
        assert reads.count() == reads.distinct().count()
    assert index.members.count() == 680 and len(index.pieces.lists) >= len(index.pieces.centres)


def test_the_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "key long, vector array<double>")
    index = vectors.build_index(none, "key", f"{tmp_path}/none")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    found, reads = vectors.search_index(index, asked, 3, keeper(spark))
    assert found.count() == 0 and reads.count() == 0 and vectors.share_read(index, reads) == 0.0


def test_matrices_find_what_single_pairs_do(spark):
    """Copies, ties, zero and null vectors and other lengths, in blocks that cut through, against a score for each pair by columns."""
    rng = random.Random(5)
    rows = [(f"k{i:03}", [rng.choice([-1.0, 0.0, 1.0, 2.5]) for _ in range(3)]) for i in range(300)]
    rows += [(f"c{i}", [1.0, 2.5, -1.0]) for i in range(30)] + [("z", [0.0] * 3), ("n", None), ("h", [1.0, None, 2.0]), ("s", [1.0, 2.0]), ("t", [2.0, 1.0]), ("e", [])]
    asked = [(i, v) for i, (_, v) in enumerate(rows) if i % 3 == 0 or i >= 330]
    vectors, queries = spark.createDataFrame(rows, "key string, vector array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>")
    pairs = queries.select("query_id", normalise(F.col("vector")).alias("a")).crossJoin(vectors.select("key", normalise(F.col("vector")).alias("b")))
    scored = pairs.select("query_id", "key", F.round(dot(F.col("b"), F.col("a")), 9).alias("score"))
    want = sorted(map(tuple, retrieval.ranked(scored, "score", ["key"], 7).collect()))
    for block in (8192, 20):
        assert sorted(map(tuple, retrieval.vector_search(queries, vectors, "key", 7, block).collect())) == want
    # Few rows, so that those without a score count as well.
    few = vectors.where("key IN ('n', 'z', 's', 'h', 'k001')")
    want = sorted(map(tuple, retrieval.ranked(scored.join(few, "key", "left_semi").select("query_id", "key", "score"), "score", ["key"], 7).collect()))
    assert sorted(map(tuple, retrieval.vector_search(queries, few, "key", 7).collect())) == want


def test_products_of_blocks_are_no_columns_of_pairs(spark):
    """The search computes no score inside an expression for each pair."""
    vectors = spark.range(50).select(F.col("id").alias("key"), F.array(F.col("id") + 0.5, F.lit(1.0)).alias("vector"))
    plan = retrieval.vector_search(vectors.withColumnRenamed("key", "query_id"), vectors, "key", 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
