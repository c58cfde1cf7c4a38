"""Words of scripts without spaces: the most probable path through the word graph of a run, by a table of word counts."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of word characters; inside them, runs of Han characters are those without spaces.
RUN = re.compile(r"[^\W_]+|_+")
HAN = "一-鿿㐀-䶿"


class Graph:
    """Word counts as log probabilities; a character that is no word counts as seen once.

    total: the sum of all counts, where counts are a part of a dictionary.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) or 1
        self.log = {w: math.log(n) - math.log(total) for w, n in counts.items() if n > 0 and w}
        self.longest, self.unseen = max(map(len, self.log), default=1), -math.log(total)

    def path(self, run: str) -> list[str]:
        """The words of the most probable segmentation; of equal ones, that with the longest word first, from left to right."""
        n = len(run)
        best, to = [0.0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i], to[i] = -math.inf, i
            for j in range(i + 1, min(n, i + self.longest) + 1):
                own = self.log.get(run[i:j], self.unseen if j == i + 1 else None)
                if own is not None and round(own + best[j], 9) >= round(best[i], 9):
                    best[i], to[i] = own + best[j], j
        words, at = [], 0
        while at < n:
            words.append(run[at : to[at]])
            at = to[at]
        return words

    def searched(self, word: str) -> Iterator[str]:
        """A word with the shorter ones inside it: all of two characters and then of three that are words, then itself."""
        for size in (2, 3):
            if len(word) > size:
                yield from (word[i : i + size] for i in range(len(word) - size + 1) if word[i : i + size] in self.log)
        yield word


def segmenter(counts: DataFrame, word: str = "word", count: str = "n", letters: str = HAN, search: bool = True, max_words: int = 1_000_000) -> Callable[[Column], Column]:
    """A tokenizer for term_table and bm25: the words of a text, those of runs of `letters` by the word graph.

    counts (word, count) is a dictionary of at most max_words words, which goes to every task; more are an error.
    Other runs of word characters are words as they are, and punctuation is none. search: long words also give the
    shorter ones inside them. The letters of words are taken as they are written.
    """
    rows = counts.select(word, F.col(count).cast("long")).where(F.col(word).isNotNull()).limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"a dictionary of over {max_words} words")
    graph = counts.sparkSession.sparkContext.broadcast(Graph({r[0]: r[1] or 0 for r in rows}))
    parts = re.compile(f"[{letters}]+|[^{letters}]+")

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[str]:
            out: list[str] = []
            for run in RUN.findall(text or ""):
                for part in parts.findall(run):
                    if not re.match(f"[{letters}]", part):
                        out.append(part)
                        continue
                    for w in graph.value.path(part):
                        out += graph.value.searched(w) if search else [w]
            return out

        return pd.Series([of(t) for t in texts], dtype="object")

    return words


def segmented(runs: DataFrame, run: str, counts: DataFrame, word: str = "word", count: str = "n") -> DataFrame:
    """(run, words): the words of each distinct run by the word graph, with a dictionary counts (word, count) of any size.

    The dictionary stays where it is: the pieces of the runs that are no longer than its longest word meet it in a
    join, and a run takes the words inside it along, so a task holds those of one run at a time. A word is in counts once.
    """
    known = counts.where(F.col(word).isNotNull()).select(F.col(word).alias("_word"), F.coalesce(F.col(count).cast("long"), F.lit(0)).alias("_n"))
    longest, total = known.agg(F.coalesce(F.max(F.length("_word")), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    asked = runs.select(run).where(F.length(run) > 0).distinct()
    at = F.explode(F.sequence(F.lit(1), F.length(run))).alias("_i")
    sizes = F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length(run) - F.col("_i") + 1))
    pieces = asked.select(run, at).select(run, F.explode(F.transform(sizes, lambda k: F.substring(F.col(run), F.col("_i"), k))).alias("_word")).distinct()
    held = pieces.join(known, "_word").groupBy(run).agg(F.collect_list(F.struct("_word", "_n")).alias("_held"))

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series, held: pd.Series) -> pd.Series:
        own = ({h["_word"]: h["_n"] for h in (() if hs is None else hs)} for hs in held)
        return pd.Series([Graph(h, total).path(t) for t, h in zip(texts, own, strict=True)], dtype="object")

    return asked.join(held, run, "left").select(run, words(F.col(run), F.col("_held")).alias("words"))
