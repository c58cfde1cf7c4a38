"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly."""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored

DIMENSIONS = ("bytes", "tokens", "rows")


#: What a dimension counts in the dot product; bytes are the law, so they lead where dimensions disagree.
WEIGHTS = (4, 1, 1)


def pack(vectors: list[tuple[int, ...]], bins: int) -> list[int]:
    """The bin of each vector: large ones first, each where its weighted dot product with the residual capacity is highest.

    A bin's capacity is an equal share of the sum in every dimension and the residual what is left of it, below
    zero once the bin is over. Ties go to the lower bin and the earlier vector. Products are compared as whole
    numbers, over a common denominator, so the packing is the same on every machine.
    """
    total = [max(1, sum(v[d] for v in vectors)) for d in range(len(WEIGHTS))]
    scale = [w * (math.prod(total) // t) for w, t in zip(WEIGHTS, total, strict=True)]
    unit = [math.prod(total) // t for t in total]
    residual = [list(unit_d * t for unit_d, t in zip(unit, total, strict=True)) for _ in range(bins)]
    out = [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: -sum(s * x for s, x in zip(scale, vectors[i], strict=True))):
        a, b, c = (s * x for s, x in zip(scale, vectors[i], strict=True))
        best = max(range(bins), key=lambda n: a * residual[n][0] + b * residual[n][1] + c * residual[n][2])
        residual[best] = [r - bins * u * x for r, u, x in zip(residual[best], unit, vectors[i], strict=True)]
        out[i] = best
    return out


def assign(bins: list, total: list[int], shards: int) -> list[int]:
    """The shard of each of bins (cell, piece, bytes, tokens, rows), sorted by cell and piece.

    Pieces of a text that fits a shard's share go together; those of a larger one are packed each by itself.
    """
    unit_of, sums = [], []
    for _, own in groupby(bins, key=lambda b: b["cell"]):
        vectors = [tuple(b[d] for d in DIMENSIONS) for b in own]
        whole = tuple(map(sum, zip(*vectors, strict=True)))
        if all(x * shards <= t for x, t in zip(whole, total, strict=True)):
            unit_of += [len(sums)] * len(vectors)
            sums.append(whole)
        else:
            unit_of += range(len(sums), len(sums) + len(vectors))
            sums += vectors
    to = pack(sums, shards)
    return [to[u] for u in unit_of]


def shard(docs: DataFrame, shards: int = 24, cells: int = 4096) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text).

    A group is all rows of one text, and stays whole if it fits a shard's share in every dimension; a larger one
    cannot, and is dealt to where it balances best, so one text may fill any part of the input. Sizes of shards are
    near equal (law `bytes`); slots count from 0 without gaps in each.

    For the packing, groups are summed by hash into cells, a fixed number whatever the input's size. One that
    outgrows a cell's share is packed by itself, and its rows are dealt by a hash of doc_id (a doc_id that alone
    has more than a cell's share of the rows: also by where they stand) into pieces of a cell's share, which tasks
    number. Cells and pieces are a few times `cells` at most, and only their sums reach the driver.

    size: UTF-8 bytes plus 8. Null and empty texts have 8 and the same crc and group. A null doc_id is dealt
    like others. Repeated rows each get a slot of their own. Of equal dot products the lower shard is taken, and
    slots of equal doc_ids follow the texts' digests. Texts of any length are read whole. An empty table gives an
    empty table. Other columns, whatever their names, are neither read nor returned.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.monotonically_increasing_id().alias("spot"),
    )
    rows = stored(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))
    sums = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    total = [max(1, x or 0) for x in sums]
    # At most three times `cells` groups exceed a cell's share, one time for each dimension.
    over = F.greatest(*[F.col(d) / F.lit(t / cells) for d, t in zip(DIMENSIONS, total, strict=True)])
    large = stored(groups.withColumn("pieces", F.ceil(over).cast("int")).where("pieces > 1").select("digest", "pieces"), "large")
    # Likewise at most `cells` pairs of a doc_id and a text have more than a cell's share of the rows.
    pairs = rows.join(F.broadcast(large), "digest", "left_semi").groupBy("digest", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max(1, total[2] / cells))
    busy = stored(pairs.select(F.col("digest").alias("busy_digest"), F.col("doc_id").alias("busy_id")), "busy")
    dealt = rows.join(F.broadcast(large), "digest", "left")
    dealt = dealt.join(F.broadcast(busy), (F.col("digest") == F.col("busy_digest")) & F.col("doc_id").eqNullSafe(F.col("busy_id")), "left")
    by = F.when(F.col("busy_digest").isNotNull(), F.xxhash64("doc_id", F.lit("piece"), "spot")).otherwise(F.xxhash64("doc_id", F.lit("piece")))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(by, F.col("pieces")).cast("int")).otherwise(-1)
    cell = F.when(F.col("pieces").isNotNull(), F.lower(F.hex("digest"))).otherwise(F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("string"))
    dealt = dealt.withColumn("piece", piece).withColumn("cell", cell)
    bins = dealt.groupBy("cell", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("cell", "piece").collect()
    to = assign(bins, total, shards)
    start, plan = [0] * shards, []
    for b, shard_no in zip(bins, to, strict=True):
        plan.append((b["cell"], b["piece"], shard_no, start[shard_no]))
        start[shard_no] += b["rows"]
    plan_table = docs.sparkSession.createDataFrame(plan, "cell string, piece int, shard int, start long")
    # Rows of a cell or piece are numbered apart and then moved to its start, so no task sees a whole shard.
    order = Window.partitionBy("cell", "piece").orderBy("doc_id", "digest")
    numbered = dealt.withColumn("n", F.row_number().over(order))
    placed = numbered.join(F.broadcast(plan_table), ["cell", "piece"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
