"""Queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import table_functions
from quillspark.functions.markup import html_markdown
from quillspark.functions.text import publish_date, strip_tags
from quillspark.operators import governance, intake, pages
from quillspark.sources.tables import load


def page_fields(spark, sf_dir):
    return pages.page_fields(load(spark, sf_dir, "pages"), "page_id", "html")


def page_links(spark, sf_dir):
    return pages.list_items(load(spark, sf_dir, "pages"), "page_id", "html", r"<li><a[^>]*>[^<]*</a></li>", {"label": "<a[^>]*>([^<]*)</a>", "target": 'href="([^"]*)"'})


def page_urls(spark, sf_dir):
    url = F.col("url")
    dated = F.concat(url, F.lit("/2024/"), F.lpad((F.col("page_id") % 14).cast("string"), 2, "0"), F.lpad((F.col("page_id") % 33).cast("string"), 2, "0"), F.lit("/"))
    title = F.when(F.col("page_id") % 6 == 0, F.lit("Rules（2023年5月1日修订）")).otherwise(F.lit("Rules"))
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    return load(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), F.regexp_extract("url", r"://[^/]+/([a-z]+)", 1).alias("column_name"), governance.is_placeholder_url(url).alias("placeholder"),
        governance.is_root_url(F.concat(F.lit("http://"), host, F.when(F.col("page_id") % 2 == 0, "/").otherwise("/x"))).alias("root"), publish_date(title, dated).alias("published"),
    )


def registry_coverage(spark, sf_dir):
    urls = load(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"://[^/]+/([a-z]+)", 1).alias("column"), "url")
    found = pages.registry_coverage(urls, urls.where("url LIKE 'https:%'"))
    return found.select("host", "n_columns", "n_registered", F.array_join("missing", ",").alias("missing"))


def richest_version(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^/?#]+)", 1).alias("host"), "page_id", F.length("html").alias("chars"))
    return pages.richest(rows, "host", F.floor(F.col("chars") / 500), "page_id")


def page_markdown(spark, sf_dir):
    """Every page as Markdown, its links made absolute by its address."""
    return load(spark, sf_dir, "pages").select("page_id", html_markdown(F.col("html"), F.col("url")).alias("markdown"))


def page_lines(spark, sf_dir):
    """The lines of every page's Markdown, by a table function in SQL."""
    table_functions.register(spark)
    load(spark, sf_dir, "pages").createOrReplaceTempView("quillspark_pages")
    return spark.sql("SELECT page_id, l.n, l.kind, l.line FROM quillspark_pages, LATERAL markdown_lines(html, url) l")


PATH_RULES = [("/en/*", "政策"), ("/de/1", "通知"), ("/fr*", "通知")]
TITLE_TAGS = [("the", ["english", "the"]), ("que", ["que", "french"]), ("ie", ["en"])]


def page_documents(spark, sf_dir):
    """Pages as documents to be reviewed: category by path, tags from language, host and title, all else by default."""
    url, html = F.col("url"), F.col("html")
    title = strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    lang, host = F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]*)"', 1), F.regexp_extract(url, r"://([^/?#]+)", 1)
    tags = intake.ordered_tags(F.array(lang), F.split(host, r"\."), intake.keyword_tags(title, TITLE_TAGS))
    category = intake.category_by_path(F.regexp_extract(url, r"://[^/?#]+([^?#]*)", 1), PATH_RULES, "FAQ")
    made = intake.document_rows(load(spark, sf_dir, "pages"), title, url, strip_tags(html), {"source_org": "site", "source_type": "third_party"}, tags=tags, category=category)
    return made.select("doc_id", "title", "source_url", "source_org", "source_type", "authority_level", "publish_date", "category", F.array_join("tags", ",").alias("tags"), "valid", "review_status", "maintainer", F.array_join("campuses", ",").alias("campuses"), F.md5("body").alias("body_md5"))


QUERIES = {f.__name__: f for f in (page_documents, page_markdown, page_lines, page_fields, page_links, page_urls, registry_coverage, richest_version)}

_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'), ' ')"
_PLAIN = r"replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"
ORACLES = {
    # For the tags that these pages have: links, one heading, and paragraphs that the next one or any other tag ends.
    "page_markdown": rf"""
WITH body AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, regexp_replace(html, '(?is)^.*?<body[^>]*>', '') AS h FROM pages),
found AS (SELECT page_id, site, regexp_extract_all(h, '(?i)<a href="[^"]*">[^<]*</a>|<h1>[^<]*</h1>|<p>(?:[^<]|</?b>|<br>)*') AS items FROM body),
each AS (SELECT page_id, site, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM found),
parts AS (
  SELECT page_id, i, CASE WHEN item LIKE '<a %' THEN '- ' || CASE WHEN site = '' THEN t ELSE '[' || t || '](' || site || regexp_extract(item, 'href="([^"]*)"', 1) || ')' END
    WHEN item LIKE '<h1>%' THEN '# ' || t ELSE p END AS line, t, p
  FROM (SELECT *, trim(regexp_replace({_PLAIN.format("regexp_replace(item, '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')) AS t,
    trim({_PLAIN.format("regexp_replace(replace(regexp_replace(item, '\\s*\\n\\s*', ' ', 'g'), '<br>', chr(10)), '<[^>]*>', '', 'g')")}, ' ' || chr(10)) AS p FROM each))
SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS markdown FROM parts WHERE t <> '' GROUP BY page_id""",
    "page_fields": rf"""
SELECT page_id, {_CLEAN.format("nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '')")} AS title,
  {_CLEAN.format("nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '')")} AS heading,
  regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '(?i)<p>')) AS INTEGER) AS n_paragraphs,
  CAST(len(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"')) AS INTEGER) AS n_links,
  array_to_string(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)[1:3], ' ') AS first_links
FROM pages""",
    "page_links": rf"""
WITH i AS (SELECT page_id, regexp_extract_all(html, '<li><a[^>]*>[^<]*</a></li>') AS items FROM pages),
r AS (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS n FROM i)
SELECT page_id, CAST(n AS INTEGER) AS n, {_CLEAN.format("nullif(regexp_extract(item, '<a[^>]*>([^<]*)</a>', 1), '')")} AS label,
  {_CLEAN.format("nullif(regexp_extract(item, 'href=\"([^\"]*)\"', 1), '')")} AS target FROM r""",
    "page_urls": r"""
WITH p AS (SELECT *, regexp_extract(url, '://([^/?#]+)', 1) AS host, page_id % 14 AS m, page_id % 33 AS d FROM pages)
SELECT page_id, host, regexp_extract(url, '://[^/]+/([a-z]+)', 1) AS column_name, contains(lower(url), 'example.') OR contains(lower(url), '.example') OR contains(lower(url), 'xxx.') AS placeholder,
  page_id % 2 = 0 AS root,
  CASE WHEN page_id % 6 = 0 THEN '2023-05-01' WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN '2024-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') ELSE 'unknown' END AS published
FROM p""",
    "registry_coverage": r"""
WITH u AS (SELECT regexp_extract(url, '://(?:www\.|m\.|blog\.)?([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/]+/([a-z]+)', 1) AS col, url FROM pages),
r AS (SELECT DISTINCT u.host, u.col, k.col IS NOT NULL AS known FROM u LEFT JOIN (SELECT DISTINCT host, col FROM u WHERE url LIKE 'https:%') k ON k.host = u.host AND k.col = u.col)
SELECT host, count(*) AS n_columns, CAST(count(*) FILTER (known) AS BIGINT) AS n_registered, coalesce(string_agg(col, ',' ORDER BY col) FILTER (NOT known), '') AS missing FROM r GROUP BY host""",
    "richest_version": r"""
WITH v AS (SELECT regexp_extract(url, '://(?:www\.|m\.|blog\.)?([^/?#]+)', 1) AS host, page_id, CAST(length(html) AS INTEGER) AS chars FROM pages)
SELECT host, count(*) OVER (PARTITION BY host) AS versions, page_id, chars FROM v QUALIFY row_number() OVER (PARTITION BY host ORDER BY chars // 500 DESC, page_id) = 1""",
}
ORACLES["page_lines"] = f"""
WITH m AS ({ORACLES["page_markdown"]}), s AS (SELECT page_id, string_split(markdown, chr(10)) AS a FROM m),
l AS (SELECT page_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS n FROM s)
SELECT page_id, CAST(n AS INTEGER) AS n, CASE WHEN line LIKE '# %' THEN 'heading' WHEN line LIKE '- %' THEN 'item' ELSE 'text' END AS kind, line FROM l"""
ORACLES["page_documents"] = rf"""
WITH p AS (
  SELECT url, {_CLEAN.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, {_CLEAN.format("html")} AS body, regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS lang,
    regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages),
t AS (
  SELECT *, list_filter(flatten([[lang], string_split(host, '.'), CASE WHEN contains(title, 'the') THEN ['english', 'the'] ELSE [] END, CASE WHEN contains(title, 'que') THEN ['que', 'french'] ELSE [] END,
    CASE WHEN contains(title, 'ie') THEN ['en'] ELSE [] END]), lambda x: x <> '') AS tags FROM p WHERE title <> '' AND body <> '')
SELECT 'kb-' || sha256(trim(coalesce(url, ''), ' ') || chr(10) || trim(title, ' '))[1:16] AS doc_id, title, coalesce(url, '') AS source_url, 'site' AS source_org, 'third_party' AS source_type, 'unknown' AS authority_level, 'unknown' AS publish_date,
  CASE WHEN path LIKE '/en/%' THEN '政策' WHEN path = '/de/1' OR path LIKE '/fr%' THEN '通知' ELSE 'FAQ' END AS category,
  CASE WHEN len(tags) = 0 THEN '未分类' ELSE array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ',') END AS tags, true AS valid, 'needs_review' AS review_status, 'unassigned' AS maintainer, '未明确' AS campuses, md5(body) AS body_md5 FROM t"""
