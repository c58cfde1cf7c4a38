"""Crawled pages: fields, links, dates, versions and the coverage of a source registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip_tags


def first_match(html: Column, pattern: str) -> Column:
    """strip_tags of a pattern's first group; null where it does not match."""
    return strip_tags(F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")))


def page_fields(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, heading, lang, n_paragraphs, n_links, first_links) of pages, by patterns alone."""
    source = F.col(html)
    links = F.regexp_extract_all(source, F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)
    return pages.select(
        key, first_match(source, r"(?is)<title>(.*?)</title>").alias("title"), first_match(source, r"(?is)<h1[^>]*>(.*?)</h1>").alias("heading"),
        F.regexp_extract(source, r'(?i)<html[^>]*\slang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all(source, F.lit(r"(?i)(<p>)"), 1)).alias("n_paragraphs"),
        F.size(links).alias("n_links"), F.array_join(F.slice(links, 1, 3), " ").alias("first_links"),
    )


def list_items(pages: DataFrame, key: str, html: str, item: str, fields: dict[str, str]) -> DataFrame:
    """One row for each match of item in a page, with n from 0 and a cleaned field for each pattern."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(item), 0)).alias("n", "_item"))
    return rows.select(key, "n", *[first_match(F.col("_item"), p).alias(name) for name, p in fields.items()])


def labelled_fields(html: Column, item: str, label: str, value: str, last: bool = False) -> Column:
    """map<label, value> of a page's labelled fields; the first value of a label counts, or the last one."""
    items = F.regexp_extract_all(html, F.lit(item), 0)
    pairs = F.transform(F.reverse(items) if last else items, lambda x: F.struct(first_match(x, label).alias("key"), F.coalesce(first_match(x, value), F.lit("")).alias("value")))
    named = F.filter(pairs, lambda p: p["key"].isNotNull() & (p["key"] != "") & (F.lit(last) | (p["value"] != "")))
    first = F.filter(F.transform(named, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), (F.array_position(F.transform(named, lambda q: q["key"]), p["key"]) == i + 1).alias("first"))), lambda p: p["first"])
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))


def field_lines(fields: Column, order: list[str]) -> Column:
    """`key: value` lines, listed keys first in their order and then others by name; pipes escaped for tables."""
    known = F.filter(F.array(*[F.lit(k) for k in order]), lambda k: F.map_contains_key(fields, k))
    others = F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in order])))
    line = lambda k: F.concat(k, F.lit(": "), F.replace(F.element_at(fields, k), F.lit("|"), F.lit("\\|")))
    return F.transform(F.concat(known, others), line)


def registry_coverage(links: DataFrame, registered: DataFrame) -> DataFrame:
    """(host, n_columns, n_registered, missing) of columns (host, column) that pages link to against (host, column)."""
    have = registered.select("host", "column", F.lit(1).alias("known")).distinct()
    rows = links.select("host", "column").distinct().join(have, ["host", "column"], "left")
    return rows.groupBy("host").agg(F.count("*").alias("n_columns"), F.count("known").alias("n_registered"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("column")))).alias("missing"))


def richest(versions: DataFrame, key: str, richness: Column, seq: str) -> DataFrame:
    """Of each key's versions the richest; the earliest of equally rich ones."""
    best = F.struct(richness, -F.col(seq))
    return versions.groupBy(key).agg(F.count("*").alias("versions"), F.max_by(F.struct(*[c for c in versions.columns if c != key]), best).alias("r")).select(key, "versions", "r.*")


def gap_rows(values: Column, factor: float = 0.75, least: float = 8.0) -> Column:
    """Group numbers of sorted (position, height) boxes: a new row where the gap passes max(least, factor * median height)."""
    heights = F.sort_array(F.transform(values, lambda v: v["height"]))
    limit = F.greatest(F.lit(least), F.lit(factor) * F.element_at(heights, (F.size(heights) / 2).cast("int") + 1))
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("last"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, v: Column) -> Column:
        row = F.when(acc["last"].isNull() | (v["position"] - acc["last"] > limit), acc["row"] + 1).otherwise(acc["row"])
        return F.struct(row.alias("row"), v["position"].cast("double").alias("last"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    return F.aggregate(F.array_sort(values), start, step)["rows"]


#: The marks of a campus service site's list pages, and how far an entry without a next one reaches.
TOTAL = r"约有\s*<span>\s*(\d+)"
FAQ_MARK, FAQ_REACH = "<em>问</em>", 6000
FAQ_QUESTION = r'(?s)<div class="ts">(.*?)</div>'
FAQ_ANSWER = r"""(?s)docNo='\d+'[^>]*class="da_high_content"[^>]*>(.*?)</h4>"""
FAQ_NUMBER = r"""(?s)docNo='(\d+)'[^>]*class="da_high_content"[^>]*>.*?</h4>"""
FAQ_BUTTON = r'(?s)<div class="(?:expand-btn|close-btn)"[^>]*>.*?</div>'
FAQ_FIELD = r"(?s)<b>[^<]{1,8}?[：:]\s*</b>\s*</td>\s*<td>[^<]*</td>"
FAQ_LABELS = {"phone": "咨询电话", "dept": "受理部门", "office": "科 室"}
GUIDE_MARK, GUIDE_REACH = r'id="data_[A-Z0-9]+">', 4000
GUIDE_FIELD = r"(?s)<b>[^<]{1,12}?[：:]\s*</b>[^<]*</td>"
GUIDE_PHONE, GUIDE_PHONE_LABEL = r"咨询电话:</b>\s*([^<\s]+)", "咨询电话"
TITLE_NOISE = r"(?:点击|查看)?(?:详情|更多)\s*$"
NORM_ITEM = r'(?s)<a[^>]*id="norm_file_\d+"[^>]*title="[^"]*"[^>]*>.*?</a>.*?<b>【发文号】</b>\s*[^|]*.*?<b>【施行日期】</b>\s*[^|]*'
NORM_FIELDS = {"doc_no": r'id="norm_file_(\d+)"', "label": r"(?s)<a[^>]*>(.*?)</a>", "named": r'title="([^"]*)"', "issue_no": r"(?s)<b>【发文号】</b>\s*([^|]*)", "effective_date": r"(?s)<b>【施行日期】</b>\s*([^|]*)"}
NORM_DETAIL = r"<span\s*>【[^】]+】</span>[^<]+"
INFO_ITEM = r'(?s)<a href="[^"]+"[^>]*dataSource[^>]*>.*?</a>.*?class="limit-lines3">.*?</div>.*?发布时间：\s*[0-9-]+\s*\| 信息来源：\s*[^<]*'
INFO_FIELDS = {"title": r"(?s)<a[^>]*>(.*?)</a>", "url": r'<a href="([^"]+)"', "snippet": r'(?s)class="limit-lines3">(.*?)</div>', "publish_date": r"发布时间：\s*([0-9-]+)", "source_org": r"信息来源：\s*([^<]*)"}


def total_hits(html: Column) -> Column:
    """How many hits a list page says there are; 0 if it says nothing."""
    return F.coalesce(F.regexp_extract(html, TOTAL, 1).try_cast("int"), F.lit(0))


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def faq_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, doc_no, question, answer, phone, dept, office): an entry from each question mark to the next; those without a question are left out."""
    cut = F.split(F.col(html), f"(?={FAQ_MARK})")
    entries = F.filter(cut, lambda x: x.startswith(FAQ_MARK))
    reach = F.transform(entries, lambda x, i: F.when(i == F.size(entries) - 1, F.left(x, F.lit(FAQ_REACH))).otherwise(x))
    rows = pages.select(key, F.posexplode(reach).alias("n", "_e"))
    answer = strip_tags(F.regexp_replace(F.regexp_extract("_e", FAQ_ANSWER, 1), FAQ_BUTTON, ""))
    fields = labelled_fields(F.col("_e"), FAQ_FIELD, r"<b>([^<]{1,8}?)[：:]", r"(?s)<td>([^<]*)</td>", last=True)
    rows = rows.select(key, "n", F.regexp_extract("_e", FAQ_NUMBER, 1).alias("doc_no"), _or_empty(first_match(F.col("_e"), FAQ_QUESTION)).alias("question"), answer.alias("answer"), fields.alias("_f"))
    return rows.where("question <> ''").select(key, "n", "doc_no", "question", "answer", *[_or_empty(F.try_element_at("_f", F.lit(label))).alias(c) for c, label in FAQ_LABELS.items()])


def guide_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, title, fields map<label, value>, phone): an entry for each title, with the labelled fields within GUIDE_REACH characters of it."""
    cut = F.split(F.col(html), f"(?={GUIDE_MARK})")
    ahead = F.transform(cut, lambda x, i: F.left(F.array_join(F.slice(cut, i + 1, F.size(cut)), ""), F.lit(GUIDE_REACH)))
    rows = pages.select(key, F.posexplode(F.filter(ahead, lambda x: x.rlike("^" + GUIDE_MARK))).alias("n", "_e"))
    title = F.trim(F.regexp_replace(_or_empty(first_match(F.col("_e"), "(?s)^" + GUIDE_MARK + "(.*?)</div>")), TITLE_NOISE, ""))
    fields = labelled_fields(F.col("_e"), GUIDE_FIELD, r"<b>([^<]{1,12}?)[：:]", r"(?s)</b>([^<]*)</td>")
    phone = F.coalesce(F.nullif(F.regexp_extract("_e", GUIDE_PHONE, 1), F.lit("")), F.try_element_at("_f", F.lit(GUIDE_PHONE_LABEL)), F.lit(""))
    rows = rows.select(key, "n", "_e", title.alias("title"), fields.alias("_f")).where("title <> ''")
    return rows.select(key, "n", "title", F.col("_f").alias("fields"), phone.alias("phone"))


def norm_items(pages: DataFrame, key: str, html: str, base_url: str) -> DataFrame:
    """(key, n, doc_no, title, issue_no, effective_date, view_url, download_url) of a list of documents with a number and a date."""
    rows = list_items(pages, key, html, NORM_ITEM, NORM_FIELDS)
    title = F.coalesce(F.nullif("label", F.lit("")), "named", F.lit(""))
    url = lambda path: F.concat(F.lit(base_url + path), F.col("doc_no"))
    return rows.select(
        key, "n", "doc_no", title.alias("title"), _or_empty(F.col("issue_no")).alias("issue_no"), _or_empty(F.col("effective_date")).alias("effective_date"),
        url("/search/normFileView.do?docNo=").alias("view_url"), url("/tool/downNormFile.do?docNo=").alias("download_url"),
    )


def norm_detail(html: Column) -> Column:
    """map<label, value> of a document's page."""
    return labelled_fields(html, NORM_DETAIL, "【([^】]+)】", r"</span>([^<]+)", last=True)


def info_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, title, url, snippet, publish_date, source_org) of a list of news; entries without a title or a full link are left out."""
    rows = list_items(pages, key, html, INFO_ITEM, INFO_FIELDS)
    rows = rows.where("coalesce(title, '') <> '' AND url LIKE 'http%'")
    return rows.select(key, "n", "title", "url", *[_or_empty(F.col(c)).alias(c) for c in ("snippet", "publish_date", "source_org")])
