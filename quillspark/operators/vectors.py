"""A stored index for exact vector search: lists around centroids, of which a query reads those that can still hold one of its best."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.embedding import normalise
from quillspark.operators.retrieval import ranked

#: What rounding can add to a score; lists are left out only where they are worse by more.
SLACK = 1e-8


@dataclass
class Pieces:
    """Parts of lists, of some piece_rows vectors: for each its list, and how far its vectors are from the centroid at least and at most.

    Their number has a bound: a piece for each piece_rows vectors and one for each of max_lists centroids.
    """

    centres: np.ndarray
    lists: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """The highest cosine that each piece can hold for each of units, by the triangle inequality over distances."""
        gap = np.sqrt(np.maximum((units * units).sum(1)[:, None] + (self.centres**2).sum(1)[None] - 2 * units @ self.centres.T, 0))[:, self.lists]
        least = np.maximum(np.maximum(gap - self.far, self.near - gap) - SLACK, 0)
        return 1 - least * least / 2


@dataclass
class VectorIndex:
    """members (key, list, piece, unit) in a folder by list, and what the driver knows of the pieces."""

    members: DataFrame
    key: str
    pieces: Pieces


def build_index(vectors: DataFrame, key: str, folder: str, max_lists: int = 1024, sample_rows: int = 50_000, piece_rows: int = 20_000, seed: int = 7) -> VectorIndex:
    """Writes vectors (key, vector) as an index under folder.

    Centroids, about the square root of the rows and max_lists at most, are those of k-means over a sample of
    sample_rows rows at most; every row is then put into the list of the nearest. A list of many rows is dealt into
    pieces, so a vector that many rows share makes no task of its own. Vectors without a direction (null or zero)
    are in no list, as their cosine with anything is none or zero.
    """
    units = vectors.select(key, normalise(F.col("vector")).alias("unit")).where(F.exists("unit", lambda x: x != 0))
    n = units.count()
    if not n:
        empty = units.select(key, F.lit(0).alias("list"), F.lit(0).alias("piece"), "unit")
        return VectorIndex(empty, key, Pieces(np.zeros((0, 1)), *(np.zeros(0, t) for t in (int, float, float))))
    chosen = units.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(1, n // sample_rows))) == 0) if n > sample_rows else units
    fitted = KMeans(k=max(1, min(max_lists, round(n**0.5))), maxIter=10, seed=seed, featuresCol="f").fit(chosen.select(array_to_vector("unit").alias("f")))
    centres = np.array(fitted.clusterCenters())

    @F.pandas_udf("list int, away double")
    def placed(column):
        import pandas as pd

        rows = np.stack(column.to_numpy())
        gap = (rows * rows).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T
        best = gap.argmin(1)
        return pd.DataFrame({"list": best.astype(np.int32), "away": np.sqrt(((rows - centres[best]) ** 2).sum(1))})

    put = units.withColumn("p", placed("unit")).select(key, "p.list", "p.away", "unit")
    salt = F.pmod(F.xxhash64(key), F.lit(1024))
    spread = put.withColumn("salt", salt)
    # A list is a file, or some where lists are so large that one task should not write each.
    spread.repartition("list", F.col("salt") % max(1, min(64, n // len(centres) // 200_000))).sortWithinPartitions("list", "salt").write.partitionBy("list").parquet(folder)
    stored = vectors.sparkSession.read.schema(T.StructType([f for f in spread.schema if f.name != "list"] + [T.StructField("list", T.IntegerType())])).parquet(folder)
    sizes = stored.groupBy("list").agg(F.count("*").alias("n"))
    pieces = F.least(F.lit(1024), F.ceil(F.col("n") / piece_rows)).cast("int")
    members = stored.join(F.broadcast(sizes.select("list", pieces.alias("pieces"))), "list").withColumn("part", (F.col("salt") % F.col("pieces")).cast("int"))
    rows = members.groupBy("list", "part").agg(F.min("away").alias("near"), F.max("away").alias("far")).orderBy("list", "part").collect()
    number = vectors.sparkSession.createDataFrame([(r["list"], r["part"], i) for i, r in enumerate(rows)], "list int, part int, piece int")
    members = members.join(F.broadcast(number), ["list", "part"]).select(key, "list", "piece", "unit")
    return VectorIndex(members, key, Pieces(centres, *(np.array([r[c] for r in rows]) for c in ("list", "near", "far"))))


def search_index(index: VectorIndex, queries: DataFrame, n: int, keep, first: int = 4, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((query_id, key, score, pos), (query_id, piece)): the n best by cosine for queries (query_id, vector), and the pieces read.

    Exactly vector_search's rows of vectors that have a direction. A query reads its pieces in the order of their
    bounds, first of them in a first round, and four times as many in each further one, as long as the bound
    reaches its n-th best score; a piece meets the queries that read it in one task, some `block` of them at a
    time. keep stores a table of a round.
    """
    spark, key = queries.sparkSession, index.key
    kind = index.members.schema[key]
    shared = spark.sparkContext.broadcast(index.pieces)
    asked = keep(queries.select("query_id", normalise(F.col("vector")).alias("unit")).where(F.exists("unit", lambda x: x != 0)))
    read_schema = T.StructType([asked.schema["query_id"], T.StructField("piece", T.IntegerType()), asked.schema["unit"]])
    hit_schema = T.StructType([asked.schema["query_id"], kind, T.StructField("score", T.DoubleType())])

    def due(begin: int, end: int | None):
        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                units = np.array(batch.column("unit").to_pylist())
                least = batch.column("least").to_numpy(zero_copy_only=False)
                bounds = shared.value.bounds(units)
                order = np.argsort(-bounds, axis=1, kind="stable")[:, begin:end]
                fits = np.take_along_axis(bounds, order, axis=1) >= least[:, None] - SLACK
                at, spot = np.nonzero(fits)
                picked = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(picked), pa.array(order[at, spot], pa.int32()), batch.column("unit").take(picked)], ["query_id", "piece", "unit"])

        return run

    def scored(members, wanted):
        members = members.sort_by(key)
        ids, q = members.column(key), wanted.column("query_id")
        if not len(ids) or not len(q):
            return pa.table({"query_id": q.slice(0, 0), key: ids.slice(0, 0), "score": pa.array([], pa.float64())})
        known, asked_units = (np.array(t.column("unit").to_pylist()) for t in (members, wanted))
        at, spots, scores = [], [], []
        for a in range(0, len(q), block):
            found = np.round(asked_units[a : a + block] @ known.T, 9)
            cut = np.sort(found, axis=1)[:, -min(n, len(ids))]
            for i, row in enumerate(found):
                near = np.flatnonzero(row >= cut[i])
                near = near[np.argsort(-row[near], kind="stable")][:n]  # members are in the order of the key
                at += [a + i] * len(near)
                spots += near.tolist()
                scores += row[near].tolist()
        return pa.table({"query_id": q.take(pa.array(at)), key: ids.take(pa.array(spots)), "score": pa.array(scores, pa.float64())})

    of, total = index.pieces.lists.tolist(), len(index.pieces.lists)
    if not total:
        return spark.createDataFrame([], hit_schema).withColumn("pos", F.lit(1)), spark.createDataFrame([], read_schema).drop("unit")
    best, reads, begin, size = None, None, 0, first
    while True:
        end = None if begin + size >= total or size > 64 * first else begin + size
        least = asked.withColumn("least", F.lit(float("-inf")))
        if best is not None:
            nth = best.where(F.col("pos") == n).select("query_id", F.col("score").alias("_nth"))
            least = asked.join(nth, "query_id", "left").select("query_id", "unit", F.coalesce("_nth", F.lit(float("-inf"))).alias("least"))
        visits = keep(least.mapInArrow(due(begin, end), read_schema))
        reads = visits.select("query_id", "piece") if reads is None else reads.unionByName(visits.select("query_id", "piece"))
        place = spark.createDataFrame([(x, i) for i, x in enumerate(of)], "list int, _piece int")
        lists = visits.select(F.col("piece").alias("_piece")).distinct().join(F.broadcast(place), "_piece").select("list").distinct()
        members = index.members.join(F.broadcast(lists), "list", "left_semi")  # only these lists' folders are read
        hits = members.select(key, "piece", "unit").groupBy("piece").cogroup(visits.groupBy("piece")).applyInArrow(scored, hit_schema)
        hits = hits if best is None else hits.unionByName(best.drop("pos"))
        best = keep(ranked(hits, "score", [key], n))
        if end is None:
            return best.select("query_id", key, "score", "pos"), reads
        begin, size = end, size * 4


def share_read(index: VectorIndex, reads: DataFrame) -> float:
    """The share of all pieces that a query reads, on average."""
    n, queries = reads.agg(F.count("*"), F.count_distinct("query_id")).first()
    return n / (queries * len(index.pieces.lists)) if queries else 0.0
