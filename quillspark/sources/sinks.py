"""Sinks: document files, guarded partition overwrites, reports and the FAQ export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def markdown_text(meta: dict[str, Column], body: Column) -> Column:
    """A Markdown document: front matter in the order given, null values left out, then the body as it is."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in meta.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"), body)


def overwrite_sources(df: DataFrame, path: str, by: str = "source") -> bool:
    """Replace the partitions of the sources in df and leave others; an empty df replaces nothing. True if written."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return True


def faq_markdown(notes: DataFrame, order: str, question: str, points: str, sources: str) -> DataFrame:
    """One row `text`: numbered questions with their points and sources. notes are a page of rows, not a corpus."""
    entry = F.concat(F.col(question), F.lit("\n- "), F.array_join(points, "\n- "), F.when(F.size(sources) > 0, F.concat(F.lit("\n\nSources: "), F.array_join(sources, " · "))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct(order, entry.alias("entry"))))
    numbered = F.transform(listed, lambda e, i: F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), e["entry"]))
    return notes.agg(F.array_join(numbered, "\n\n").alias("text"))


def rewritten_on_publish(docs: DataFrame, status: str = "verified", checked: str = "", maintainer: str = "") -> DataFrame:
    """docs with the review fields set for publication; the body and other fields stay."""
    return docs.withColumns({"review_status": F.lit(status), "valid": F.lit(True), "last_checked_at": F.lit(checked), "maintainer": F.lit(maintainer)})


def counted_write(df: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict:
    """The counts (aggregate columns) of the rows of df as write writes them: taken by the write itself, in no scan of its own."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return seen.get


def set_aside(df: DataFrame, reason: Column, folder: str) -> None:
    """Writes df under folder in one pass: `place=kept`, and a place for each reason of rows that are moved out of the way (null: none)."""
    df.withColumn("place", F.coalesce(reason, F.lit("kept"))).write.partitionBy("place").parquet(folder)


def write_manifests(results: DataFrame, errors: DataFrame, folder: str, fetched_at: str) -> bool:
    """One JSON manifest a source under folder, of results (source, key, status, doc_id, chars) and errors (source, error); see files.manifest.

    Sources without results keep the manifest they have, as a run that found nothing must not lose what is known.
    True if any was written.
    """
    listed = results.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("status", "doc_id", "chars").alias("value"))))).alias("results"))
    said = errors.groupBy(F.col("source").alias("_s")).agg(F.array_sort(F.collect_list("error")).alias("errors"))
    made = listed.join(said, F.col("source") == F.col("_s"), "left").select("source", F.lit(fetched_at).alias("fetched_at"), "results", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
    if made.isEmpty():
        return False
    text = made.select(F.col("source").alias("name"), F.to_json(F.struct("source", "fetched_at", "results", "errors"), {"ignoreNullFields": "false"}).alias("value"))
    text.repartition("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(folder)
    return True
