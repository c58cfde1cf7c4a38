"""Parsers as table functions, to be called in FROM with LATERAL: rows of a schema that is known before anything runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillspark.functions.chunking import short_lines
from quillspark.functions.markup import markdown

KINDS = (("heading", re.compile(r"#{1,6} ")), ("item", re.compile(r" *(?:- |1\. )")), ("table", re.compile(r"\|")), ("rule", re.compile(r"---$")))


def _texts(**arguments: AnalyzeArgument) -> None:
    for name, argument in arguments.items():
        if not isinstance(argument.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"{name} has to be a text, not {argument.dataType.simpleString()}")


@udtf
class MarkdownLines:
    """markdown_lines(html, url): the lines of a page's Markdown (n from 0, kind, line); no page has no rows."""

    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument) -> AnalyzeResult:
        _texts(html=html, url=url)
        return AnalyzeResult(T.StructType().add("n", T.IntegerType()).add("kind", T.StringType()).add("line", T.StringType()))

    def eval(self, html: str | None, url: str | None) -> Iterator[tuple]:
        for n, line in enumerate((markdown(html, url) or "").split("\n")):
            if line or n:
                yield n, next((kind for kind, form in KINDS if form.match(line)), "text"), line


@udtf
class CutParagraph:
    """cut_paragraph(text, limit): a paragraph in pieces of at most limit characters (n, start, piece), cut after sentences where it can be."""

    @staticmethod
    def analyze(text: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        _texts(text=text)
        if not limit.isConstantExpression or not isinstance(limit.value, int) or limit.value < 1:
            raise ValueError("limit has to be a whole number above zero, the same for all rows")
        return AnalyzeResult(T.StructType().add("n", T.IntegerType()).add("start", T.IntegerType()).add("piece", T.StringType()))

    def eval(self, text: str | None, limit: int) -> Iterator[tuple]:
        at = 0
        for n, piece in enumerate(short_lines(text or "", limit)):
            yield n, at, piece
            at += len(piece)


def register(spark: SparkSession) -> None:
    """Makes markdown_lines and cut_paragraph known to the session's SQL."""
    spark.udtf.register("markdown_lines", MarkdownLines)
    spark.udtf.register("cut_paragraph", CutParagraph)
