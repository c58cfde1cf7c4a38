"""Batches under a budget for a model: rows of a key in pieces of bounded size and count, and answers back by id."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def batches(rows: DataFrame, key: str, id: str, text: str, max_chars: int = 6000, max_rows: int = 50, excerpt: int = 150, part_chars: int = 2_000_000) -> DataFrame:
    """(key, part, batch, ids, excerpts) of rows (key, id, text): of each key all rows once, at most max_chars characters and max_rows rows a batch.

    A row counts with its excerpt, the first `excerpt` characters; null and empty texts are rows too. A key of more
    than part_chars characters or as many rows is dealt into parts by its ids, so its batches are made in many
    tasks. Inside a part rows are in the order of id; a batch takes those that begin in one window of
    max_chars - excerpt characters, so the last of them still fits.
    """
    if excerpt * 2 > max_chars:
        raise ValueError("an excerpt has to fit half of max_chars")
    cut = rows.select(key, id, F.left(F.coalesce(F.col(text), F.lit("")), F.lit(excerpt)).alias("_cut"))
    sizes = cut.groupBy(F.col(key).alias("_key")).agg(F.sum(F.greatest(F.length("_cut"), F.lit(1))).alias("_size"))
    parts = F.ceil(F.col("_size") / part_chars).cast("long")
    place = F.conv(F.left(F.md5(F.col(id).cast("string")), F.lit(8)), 16, 10).cast("long")
    dealt = cut.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).withColumn("part", F.pmod(F.coalesce(place, F.lit(0)), parts).cast("int")).drop("_key", "_size")
    before = Window.partitionBy(key, "part").orderBy(id)
    begins = F.coalesce(F.sum(F.length("_cut")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    window = F.floor(begins / (max_chars - excerpt))
    placed = dealt.withColumn("_window", window)
    # Within a window, every max_rows rows are a batch.
    turn = F.floor((F.row_number().over(Window.partitionBy(key, "part", "_window").orderBy(id)) - 1) / max_rows)
    placed = placed.withColumn("_turn", turn)
    listed = F.array_sort(F.collect_list(F.struct(id, "_cut")))
    grouped = placed.groupBy(key, "part", "_window", "_turn").agg(listed.alias("_l"))
    number = F.row_number().over(Window.partitionBy(key, "part").orderBy("_window", "_turn"))
    return grouped.select(key, "part", number.alias("batch"), F.col("_l")[id].alias("ids"), F.col("_l._cut").alias("excerpts"))


def prompt(ids: Column, excerpts: Column, instructions: str) -> Column:
    """instructions, and then a line `- [id] excerpt` for each row; line feeds of excerpts are blanks."""
    lines = F.transform(F.arrays_zip(ids.alias("i"), excerpts.alias("x")), lambda r: F.concat(F.lit("- ["), r["i"].cast("string"), F.lit("] "), F.regexp_replace(r["x"], r"\s*\n\s*", " ")))
    return F.concat(F.lit(instructions + "\n"), F.array_join(lines, "\n"))


def asked(made: DataFrame, id: str, instructions: str, model: Callable[[list[str]], list[str | None]], kind: str = "long") -> DataFrame:
    """(id, answer) of batches: the model is given prompts, an Arrow batch of them at a time, and answers each with a JSON list of objects with an id.

    Only ids of the batch count, and of several objects with one id the first. What is no such list, or an error of
    the model, answers nothing; it ends no job.
    """

    @F.pandas_udf("string")
    def answered(prompts: pd.Series) -> pd.Series:
        try:
            found = model(prompts.tolist())
        except Exception:  # noqa: BLE001 a model that fails answers nothing, by contract
            found = [None] * len(prompts)
        return pd.Series(found, dtype="object")

    listed = F.from_json(F.regexp_extract("_raw", r"(?s)(\[.*\])", 1), "array<map<string,string>>")
    rows = made.select("ids", answered(prompt(F.col("ids"), F.col("excerpts"), instructions)).alias("_raw"))
    each = rows.select("ids", F.posexplode(listed).alias("_n", "_m")).select("ids", "_n", F.try_element_at("_m", F.lit("id")).try_cast(kind).alias(id), F.to_json("_m").alias("answer"))
    return each.where(F.array_contains("ids", F.col(id))).groupBy(id).agg(F.min_by("answer", "_n").alias("answer"))
