"""Text functions: words, snippets, headings, citations, dates and small cleaners, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores in their order and case; the default tokenizer."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def cjk_bigrams(text: Column) -> Column:
    """tokens, with runs of Han characters as overlapping pairs, for scripts without spaces."""
    pairs = lambda w: F.when(
        w.rlike(r"^\p{IsHan}{2,}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    ).otherwise(F.array(w))
    split = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{IsHan}+)", " $1 "), WORD_BREAK)
    return F.flatten(F.transform(F.filter(split, lambda w: w != ""), pairs))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, n: int = 40) -> Column:
    """One line of preview: without a leading 《title》 line and Markdown marks, cut at n with an ellipsis."""
    body = F.when(F.ltrim(text).startswith("《") & text.contains("\n"), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(text)
    body = squeeze(F.regexp_replace(body, "[#>|*`]+", " "))
    return F.when(F.length(body) > n, F.concat(F.left(body, F.lit(n)), F.lit("…"))).otherwise(body)


def strip_citations(text: Column) -> Column:
    """Without `[n]` of one to three digits; four digits are a year."""
    return F.regexp_replace(text, r"\[[0-9]{1,3}\]", "")


def renumber_citations(text: Column, n_sources: Column) -> Column:
    """struct<text, cited>: `[n]` within the sources renumbered by first appearance; cited lists the old numbers.

    Numbers outside the sources stay. Without sources, marks of one to three digits are taken out.
    """
    number = lambda m: F.regexp_extract(m, r"^\[([0-9]{1,4})\]", 1).try_cast("int")
    # Pieces that begin with a mark: the text is cut before each.
    pieces = F.split(text, r"(?=\[[0-9]{1,4}\])", -1)
    used = F.array_distinct(F.filter(F.transform(pieces, number), lambda n: n.isNotNull() & (n >= 1) & (n <= n_sources)))
    one = lambda p: F.when(F.array_position(used, number(p)) > 0, F.regexp_replace(p, r"^\[[0-9]{1,4}\]", F.concat(F.lit("["), F.array_position(used, number(p)).cast("string"), F.lit("]")))).otherwise(p)
    made = F.array_join(F.transform(pieces, one), "")
    return F.when(n_sources == 0, F.struct(strip_citations(text).alias("text"), F.array().cast("array<int>").alias("cited"))).otherwise(F.struct(made.alias("text"), used.alias("cited")))


def turn_summary(answer: Column, n: int = 2, width: int = 40) -> Column:
    """The first n sentences of an answer cut to width, which stand in where no model summarises."""
    clean = F.regexp_replace(answer, r"\[[0-9]{1,4}\]", "")
    sentences = F.slice(F.split(clean, r"(?<=[。！？!?])"), 1, n)
    kept = F.filter(F.transform(sentences, lambda s: F.left(F.trim(s), F.lit(width))), lambda s: s != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.left(clean, F.lit(width))))


def acceptable_rewrite(original: Column, rewrite: Column, floor: int = 60, times: int = 4) -> Column:
    """rewrite, but original where it is missing, blank or longer than max(floor, times * original)."""
    too_long = F.length(rewrite) > F.greatest(F.lit(floor), F.length(original) * times)
    return F.when(rewrite.isNull() | (F.trim(rewrite) == "") | too_long, original).otherwise(F.trim(rewrite))


def clean_title(title: Column) -> Column:
    """Without a `（2024年5月1日修订）` suffix, so that versions of a document share an id."""
    return squeeze(F.regexp_replace(title, r"[（(]\d{4}年\d{1,2}月\d{1,2}日(?:修订|更新)?[)）]", ""))


def publish_date(title: Column, url: Column) -> Column:
    """The title's revision date, else the link's first /YYYY/MMDD/ of a month and day in range, else unknown."""
    part = lambda i: F.regexp_extract(title, r"[（(](\d{4})年(\d{1,2})月(\d{1,2})日(?:修订|更新)?[)）]", i)
    # Other numbers of four digits, as of a page, may stand before the year.
    year, month, day = (F.regexp_extract(url, r"/(\d{4})/(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])/", i) for i in (1, 2, 3))
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).when(year != "", F.concat_ws("-", year, month, day)).otherwise("unknown")


def promote_headings(text: Column, max_chars: int = 30) -> Column:
    """Short lines numbered `一、` as `## ` headings; long ones and those that end a sentence stay text."""
    numbered = r"^[一二三四五六七八九十]+、\s*"

    def line(x: Column) -> Column:
        s = F.trim(x)
        is_heading = s.rlike(numbered + r"\S") & (F.length(s) <= max_chars) & ~s.rlike("[。；：]$")
        return F.when(is_heading, F.concat(F.lit("## "), F.regexp_replace(s, numbered, ""))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def strip_tags(html: Column) -> Column:
    """Text of a piece of HTML: tags out without a gap, four entities resolved in a fixed order, white space squeezed."""
    out = F.regexp_replace(html, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def without_zero_width(text: Column) -> Column:
    return F.translate(text, "​‌‍﻿", "")


def safe_filename(text: Column, n: int = 80) -> Column:
    """Characters that file systems refuse as underscores, at most n characters, `untitled` if nothing is left."""
    clean = F.trim(F.left(squeeze(F.regexp_replace(text, r'[\\/:*?"<>|\n\r\t]+', "_")), F.lit(n)))
    return F.when(clean == "", "untitled").otherwise(clean)


def join_cut(values: Column, separator: str, n: int) -> Column:
    """Joined values cut at n characters, back to the last separator so that no value is torn."""
    whole = F.array_join(values, separator)
    return F.when(F.length(whole) <= n, whole).otherwise(F.regexp_replace(F.left(whole, F.lit(n)), f"{separator}[^{separator}]*$", ""))


def short_title(title: Column, n: int = 120) -> Column:
    """A title of at most n characters, with an ellipsis in place of what is over."""
    return F.when(F.length(title) > n, F.concat(F.left(title, F.lit(n - 1)), F.lit("…"))).otherwise(title)


def plain_heading(line: Column) -> Column:
    """A Markdown heading as text: links as their labels, HTML tags and number signs at both ends out."""
    labels = F.regexp_replace(line, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(F.regexp_replace(labels, "<[^>]+>", ""), r"^[\s#]+|[\s#]+$", "")


def first_heading(markdown: Column, fallback: Column) -> Column:
    """plain_heading of the first line that begins with a number sign; fallback where there is none or nothing is left."""
    line = F.regexp_extract(F.coalesce(markdown, F.lit("")), r"(?m)^(#[^\r\n]*)", 1)
    return F.coalesce(F.nullif(plain_heading(line), F.lit("")), fallback)
