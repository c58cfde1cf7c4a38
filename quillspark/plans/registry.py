"""All registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from quillspark.plans import dialogue, governance, pages, ratings, retrieval, text, usage

FAMILIES = (usage, ratings, governance, text, retrieval, pages, dialogue)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
