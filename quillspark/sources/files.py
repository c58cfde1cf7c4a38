"""File sources: Markdown with front matter, rating CSVs, JSON dictionaries, keep lists, registries and binary pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.fixed_values import PUBLISHED_FOLDERS
from quillspark.functions.text import without_zero_width


def relative(path: Column, root: str) -> Column:
    """A file's path below root, whatever the scheme that its name came with."""
    bare = root.rstrip("/").split("://")[-1]
    return F.regexp_replace(F.url_decode(path), "^.*?" + re.escape(bare) + "/", "")


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of all Markdown files below root; one row a file, an empty one for an empty file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return rows.select(relative(F.col("path"), root).alias("path"), F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\\ufeff", "").alias("raw"))


def published(files: DataFrame, folders: list[str] = PUBLISHED_FOLDERS) -> DataFrame:
    return files.where(F.substring_index("path", "/", 1).isin(folders) & F.col("path").contains("/"))


def ignored_count(files: DataFrame, folders: list[str] = PUBLISHED_FOLDERS) -> DataFrame:
    return files.join(published(files, folders).select("path"), "path", "left_anti").agg(F.count("*").alias("ignored"))


def front_matter(files: DataFrame) -> DataFrame:
    """files with meta (map<string,string>, lists as YAML flow text), body and error (null if the block could be read).

    YAML has no built-in reader, so blocks go to Python in batches; bodies stay where they are. A file without a
    block has an empty map; one that is not UTF-8 or whose block is no mapping has an error and no map.
    """
    block = F.regexp_extract("raw", r"^---[ \t]*\r?\n((?s:.*?))(?:^|\n)---[ \t]*(?:\r?\n|$)", 1)
    has = F.col("raw").rlike(r"^---[ \t]*\r?\n(?s:.*?)\n?---[ \t]*(\r?\n|$)")

    kind = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def parsed(blocks: pd.Series) -> pd.DataFrame:
        def of(text: str | None) -> tuple[dict | None, str | None]:
            if text is None:
                return None, "not UTF-8"
            try:
                found = yaml.safe_load(text) or {}
            except yaml.YAMLError as e:
                return None, f"front matter: {type(e).__name__}"
            if not isinstance(found, dict):
                return None, "front matter: not a mapping"
            flat = lambda v: None if v is None else ("true" if v else "false") if isinstance(v, bool) else yaml.safe_dump(v, default_flow_style=True, allow_unicode=True).strip() if isinstance(v, (list, dict)) else str(v)
            return {str(k): flat(v) for k, v in found.items()}, None

        return pd.DataFrame([of(b) for b in blocks], columns=["meta", "error"])

    body = F.regexp_replace("raw", r"^---[ \t]*\r?\n(?s:.*?)\n?---[ \t]*(\r?\n|$)", "")
    rows = files.withColumn("_p", parsed(F.when(F.col("raw").isNotNull(), F.when(has, block).otherwise(""))))
    return rows.select(*files.columns, F.col("_p.meta").alias("meta"), F.when(has, body).otherwise(F.col("raw")).alias("body"), F.col("_p.error").alias("error"))


def flow_list(text: Column) -> Column:
    """array<string> of a `[a, b]` text; a scalar is one member, null and blank none."""
    inner = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^\[|\]$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return F.filter(parts, lambda x: x != "")


def header_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV file with a header; blank or malformed numbers are zero."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numbers})


def comment_csvs(spark: SparkSession, glob: str, prefix: str = "comment_") -> DataFrame:
    """Positional comment files: college from the file's name; rows without a whole teacher id, as headers are, are skipped."""
    schema = "id string, teacher string, x string, time string, net string, up string, down string, content string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("escape", '"').option("mode", "PERMISSIVE").csv(glob)
    college = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), f"^{re.escape(prefix)}(.*)\\.csv$", 1)
    long = lambda c: F.col(c).try_cast("long").alias(c)
    rows = rows.select(college.alias("college"), long("id"), F.col("teacher").try_cast("long").alias("teacher_id"), F.coalesce(F.unix_timestamp(F.try_to_timestamp("time")), F.lit(0).cast("long")).alias("published_at"), long("net"), long("up"), long("down"), "content")
    return rows.where("teacher_id IS NOT NULL AND content IS NOT NULL")


def json_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One column `value` of a whole JSON file; a missing or malformed file gives no rows."""
    try:
        rows = spark.read.option("wholetext", "true").text(path)
        found = rows.select(F.from_json("value", schema).alias("value")).where("value IS NOT NULL")
        found.isEmpty()
        return found
    except Exception as e:  # noqa: BLE001 a missing file counts as an empty one, anything else does not
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], T.StructType([T.StructField("value", T._parse_datatype_string(schema))]))
        raise


def grade_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, course, gpa, samples, std) of `{name: [[course, gpa, samples, std], ...]}`; missing places are null."""
    rows = json_text(spark, path, "map<string,array<array<string>>>")
    long = rows.select(F.explode("value").alias("name", "courses")).select("name", F.explode("courses").alias("c"))
    at = lambda i: F.try_element_at("c", F.lit(i))
    return long.select("name", at(1).alias("course"), at(2).try_cast("double").alias("gpa"), at(3).alias("samples"), at(4).try_cast("double").alias("std"))


def slang_file(spark: SparkSession, path: str) -> DataFrame:
    """(term, type, names) of a slang dictionary whose values are a text or a list of texts."""
    rows = json_text(spark, path, "map<string,struct<type:string,value:string>>")
    long = rows.select(F.explode("value").alias("term", "entry"))
    many = F.from_json("entry.value", "array<string>")
    return long.select("term", "entry.type", F.coalesce(many, F.array("entry.value")).alias("names"))


def keep_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines `src` or `src|dst`; blank lines are dropped, dst is null where none is given."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return lines.select(F.trim(F.split_part("line", F.lit("|"), F.lit(1))).alias("src"), F.nullif(F.trim(F.split_part("line", F.lit("|"), F.lit(2))), F.lit("")).alias("dst"))


def kept_targets(keep: DataFrame, site: str, categories: list[str]) -> DataFrame:
    """(src, target, category, is_fix, known) of keep_list's lines of a site: where below the published folders a file is to go.

    Lines whose source is of another site are left out. The target is dst, or src without the site's folder; zero-width
    characters are taken out, and a dst that is a folder gets the source's file name. known: its first folder is one
    of categories and holds it.
    """
    is_fix = F.col("dst").isNotNull()
    dst = without_zero_width(F.coalesce("dst", "src"))
    name = F.substring_index("src", "/", -1)
    dst = F.when(is_fix & ~F.lower(dst).endswith(".md"), F.concat(F.regexp_replace(dst, "/+$", ""), F.lit("/"), name)).otherwise(dst)
    target = F.when(F.substring_index(dst, "/", 1).startswith(site), F.regexp_replace(dst, "^[^/]*/", "")).otherwise(dst)
    rows = keep.where(F.substring_index("src", "/", 1).startswith(site)).select("src", target.alias("target"), is_fix.alias("is_fix"))
    category = F.substring_index("target", "/", 1)
    return rows.select("src", "target", category.alias("category"), "is_fix", (F.col("target").contains("/") & category.isin(categories)).alias("known"))


def review_queue(documents: DataFrame, below: str = "") -> DataFrame:
    """The rows of front_matter's documents that need a review, with a path that begins with below, outside staging folders."""
    waiting = F.try_element_at("meta", F.lit("review_status")) == "needs_review"
    return documents.where(waiting & F.col("path").startswith(below) & ~F.concat(F.lit("/"), F.col("path")).contains("/staging/"))


def listed_urls(sources: DataFrame, source: str, list_url: str, pattern: str, max_pages: str, links: Callable[[str], list[str]]) -> DataFrame:
    """(source, url, place): detail URLs of each source's list pages, in their order and once each.

    Page 1 is list_url (a column), page N the same with N before its .htm or .psp. links gives a page's URLs and is
    called in the tasks, a source's pages in turn until one fails or has no URL that pattern (a column) matches.
    """

    def of(address: str, wanted: str, most: int) -> Iterator[str]:
        stem = re.match(r"(.*)\.(htm|psp)$", address)
        for page in range(1, (most if stem else 1) + 1):
            try:
                found = [u for u in links(address if page == 1 else f"{stem[1]}{page}.{stem[2]}") if re.match(wanted, u)]
            except Exception:  # noqa: BLE001 a list page that cannot be had ends the list, by contract
                return
            if not found:
                return
            yield from found

    def walked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = [(r[0], u, n) for r in rows.itertuples(index=False) for n, u in enumerate(dict.fromkeys(of(r[1], r[2], int(r[3]))))]
            yield pd.DataFrame(out, columns=["source", "url", "place"])

    asked = sources.select(source, list_url, pattern, F.coalesce(F.col(max_pages).cast("int"), F.lit(1)))
    return asked.mapInPandas(walked, "source string, url string, place int")


REGISTRY_FIELDS = ("name", "source_org", "authority_level", "category", "source_type", "list_url")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Enabled sources of a YAML registry; raises with all sources that miss a required field. The file is configuration."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())
    sources = [s for s in (yaml.safe_load(text) or {}).get("sources", []) if s.get("enabled", True)]
    bad = {s.get("name"): missing for s in sources if (missing := [f for f in REGISTRY_FIELDS if not s.get(f)])}
    if bad:
        raise ValueError(f"sources without required fields: {bad}")
    return spark.createDataFrame([[str(s[f]) for f in REGISTRY_FIELDS] for s in sources], ", ".join(f"{f} string" for f in REGISTRY_FIELDS))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, key, status, doc_id, chars) of crawl manifests, one JSON object a file."""
    schema = "source string, fetched_at string, results map<string,struct<status:string,doc_id:string,chars:long>>, errors array<string>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select("source", F.explode("results").alias("key", "r")).select("source", "key", "r.*")


def fetched(urls: DataFrame, url: str, fetch: Callable[[str], bytes | None]) -> DataFrame:
    """urls with content (binary): fetch is called in the tasks, in batches; what fails is null and ends no job."""

    @F.pandas_udf(T.BinaryType())
    def contents(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in parts:
            out = []
            for name in names:
                try:
                    out.append(fetch(name) if name else None)
                except Exception:  # noqa: BLE001 a page that cannot be had is a null, by contract
                    out.append(None)
            yield pd.Series(out, dtype="object")

    return urls.withColumn("content", contents(F.col(url)))
