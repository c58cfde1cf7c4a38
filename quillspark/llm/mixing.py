"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored, unused


def source_counts(docs: DataFrame) -> DataFrame:
    """(source, n) of docs, counted once and stored."""
    return stored(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")


def tempered_weights(counts: DataFrame, temperature: float = 2.0) -> DataFrame:
    """(source, weight) of source_counts: each source's number of rows to the power 1 / temperature."""
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(1 / temperature)).alias("weight"))


def replication_rates(counts: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """(source, rate): how often a document of each source of source_counts is to appear on average.

    A source's share of the rows is its weight over the sum of the weights of the sources present; total: the
    expected number of rows (as many as there are by default). A source without a positive weight has rate 0.
    """
    w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("w"))
    known = counts.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(0.0))
    all_w, all_n = known.agg(F.sum("w"), F.sum("n")).first()
    if not all_w:
        return known.select("source", F.lit(0.0).alias("rate"))
    goal = float(all_n) if total is None else float(total)
    return known.select("source", (F.lit(goal) * F.col("w") / F.lit(all_w) / F.col("n")).alias("rate"))


def unit_hash(seed: int, *values: Column) -> Column:
    """A number of [0, 1) from the md5 of the seed and the values' texts: 52 bits of it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_inverse(rate: Column, u: Column) -> Column:
    """The smallest k whose Poisson distribution function at rate exceeds u, for rates that exp(-rate) bears, to 600 or so.

    Sums the function's terms until they pass u.
    """
    steps = F.sequence(F.lit(1), F.ceil(rate * 2 + 12 * F.sqrt(rate) + 20).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        more = acc["cdf"] <= u
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), F.when(more, i).otherwise(acc["k"]).alias("k"))

    return F.when(rate <= 0, 0).otherwise(F.aggregate(steps, start, step)["k"])


def poisson_draw(rate: Column, seed: int, value: Column, most: float = 500.0) -> Column:
    """A Poisson draw at a hash of (seed, value). A rate over `most` is the sum of draws of equal parts of it, each at its own hash."""
    parts = F.ceil(rate / most).cast("int")
    part = lambda acc, j: acc + poisson_inverse(rate / parts, unit_hash(seed, value, j))
    return F.when(parts <= 1, poisson_inverse(rate, unit_hash(seed, value))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), F.lit(0), part))


def poisson_mix(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 8, shuffle: bool = True, max_broadcast: int = 100_000, counts: DataFrame | None = None) -> DataFrame:
    """docs' columns plus copy (int, from 1) and mix_key (string): every document as often as its draw says.

    The number of copies inverts the Poisson distribution with the source's rate at a hash of (seed, doc_id),
    so it depends on neither order nor partitioning, and repeated rows of a doc_id are drawn alike. The rows
    are shuffled globally: dealt out and ordered by mix_key, a hash of (seed, doc_id, copy). A null source is
    a source of its own; a null doc_id is hashed as the empty text; texts are not looked at; an empty table gives
    an empty table. If docs has a column copy or mix_key, it stays and the new one gets underscores before its name.
    Weights are one row a source and as large as the configuration that names them. counts: source_counts(docs),
    where they are known already.
    """
    counts = source_counts(docs) if counts is None else counts
    source, rate, draw, copy, mix_key = (unused(c, docs) for c in ("of_source", "rate", "draw", "copy", "mix_key"))
    rates = replication_rates(counts, weights, total).where("rate > 0").select(F.col("source").alias(source), F.col("rate").alias(rate))
    # As a rule sources are few and their table is broadcast; beyond max_broadcast they are joined by a shuffle.
    if rates.limit(max_broadcast + 1).count() <= max_broadcast:
        rates = F.broadcast(rates)
    drawn = docs.join(rates, F.col("source").eqNullSafe(F.col(source)), "inner")
    drawn = drawn.withColumn(draw, poisson_draw(F.col(rate), seed, F.col("doc_id"))).where(F.col(draw) > 0)
    out = drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(draw))).alias(copy))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(copy).cast("string")))
    out = out.withColumn(mix_key, key)
    return out.repartition(F.col(mix_key)).sortWithinPartitions(mix_key) if shuffle else out
