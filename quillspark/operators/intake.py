"""From parsed pages to documents: categories, tags, default metadata, and what a run found new, changed or the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.operators.governance import make_doc_id


def category_by_path(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The category of the first of rules (path, category) that fits: a rule that ends with `*` by the beginning, any other as a whole."""
    out = None
    for rule, category in rules:
        fits = path.startswith(rule[:-1]) if rule.endswith("*") else path == rule
        out = F.when(fits, category) if out is None else out.when(fits, category)
    return F.lit(default) if out is None else out.otherwise(default)


def ordered_tags(*groups: Column) -> Column:
    """The tags of groups (arrays), trimmed, each once and where it comes first; null groups and empty tags are left out."""
    none = F.array().cast("array<string>")
    tags = F.transform(F.flatten(F.array(*[F.coalesce(g, none) for g in groups])), lambda t: F.trim(t))
    return F.array_distinct(F.filter(tags, lambda t: t != ""))


def keyword_tags(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The tags of each of rules (needle, tags) whose needle is in text, in the order of rules."""
    found = [F.when(F.contains(text, F.lit(needle)), F.array(*map(F.lit, tags))) for needle, tags in rules]
    return F.flatten(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def document_rows(rows: DataFrame, title: Column, url: Column, body: Column, source: dict[str, str], date: Column | None = None, tags: Column | None = None, category: Column | None = None) -> DataFrame:
    """Documents of parsed rows, still to be reviewed: metadata as make_doc_id and source have them, all else by default.

    source: source_org, source_type, authority_level, category and maintainer of the site that rows are from; what
    it lacks is unknown or unspecified. Columns are in the order in which metadata are written. A row without a title or a body gives no document.
    """
    none, unspecified = F.array().cast("array<string>"), F.array(F.lit(V.UNSPECIFIED))
    given = lambda c, other: F.lit(source.get(c, other))
    made = rows.select(F.trim(title).alias("title"), F.coalesce(url, F.lit("")).alias("source_url"), body.alias("body"), (F.lit(None).cast("string") if date is None else date).alias("publish_date"), (none if tags is None else tags).alias("tags"), (given("category", "FAQ") if category is None else category).alias("category"))
    made = made.where("coalesce(title, '') <> '' AND coalesce(trim(body), '') <> ''")
    return made.select(
        F.lit(V.SCHEMA_VERSION).alias("schema_version"), make_doc_id(F.col("title"), F.col("source_url")).alias("doc_id"), "title", "source_url", given("source_org", V.UNIVERSITY).alias("source_org"),
        given("source_type", "unknown").alias("source_type"), given("authority_level", "unknown").alias("authority_level"), F.coalesce("publish_date", F.lit("unknown")).alias("publish_date"), "category",
        F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit(V.UNTAGGED))).alias("tags"), F.lit(True).alias("valid"), F.lit("needs_review").alias("review_status"),
        F.lit(None).cast("string").alias("last_checked_at"), given("maintainer", "unassigned").alias("maintainer"), unspecified.alias("applies_to"), unspecified.alias("campuses"), unspecified.alias("colleges"),
        F.lit(None).cast("string").alias("effective_from"), F.lit(None).cast("string").alias("effective_until"), none.alias("supersedes"), none.alias("superseded_by"), "body",
    )


def first_files(files: DataFrame, id: str, path: str) -> DataFrame:
    """files with one row an id, that of the first path; rows without an id are left out."""
    return files.where(F.col(id).isNotNull()).groupBy(id).agg(F.min_by(F.struct(*[c for c in files.columns if c != id]), path).alias("_f")).select(id, "_f.*")


def body_states(found: DataFrame, files: DataFrame, id: str, path: str, body: str) -> DataFrame:
    """found with old_path and state: new, same or updated, by the body of the first file that has its id."""
    old = first_files(files.select(id, path, body), id, path).select(F.col(id).alias("_id"), F.col(path).alias("old_path"), F.col(body).alias("_old"))
    state = F.when(F.col("old_path").isNull(), "new").when(F.col("_old").eqNullSafe(F.col(body)), "same").otherwise("updated")
    return found.join(old, F.col(id) == F.col("_id"), "left").withColumn("state", state).drop("_id", "_old")


def changed_fields(before: DataFrame, after: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """(id, changed, fields) of rows in both tables: whether any of fields differs, and which, in the order given. Null equals null."""
    a = before.select(F.col(id), *[F.col(f).alias(f"_{n}") for n, f in enumerate(fields)])
    both = a.join(after.select(id, *fields), id)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_{n}").eqNullSafe(F.col(f)), F.lit(f)) for n, f in enumerate(fields)]))
    return both.select(id, (F.size(differ) > 0).alias("changed"), differ.alias("fields"))
