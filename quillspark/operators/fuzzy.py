"""Names close to a text by the matching-block ratio: a similarity join with an exact filter on their letters."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _numbered_letters(text: str) -> Column:
    """The letters of text, each with how often it has occurred so far, as a set of strings."""
    letters = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")))


def _rare_first(side: DataFrame, text: str, order: DataFrame) -> DataFrame:
    """side (text, letters) with its letters in the order of a table (letter, seen): rarest first."""
    spread = side.select(text, F.explode("letters").alias("letter")).join(order, "letter")
    return spread.groupBy(text).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "letter"))), lambda x: x["letter"]).alias("letters"))


def candidates(asked: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """(asked, name) of asked (asked) and known (name), both distinct: all pairs whose ratio can be cutoff or more, and few others.

    The ratio is twice the matched letters over both lengths, and no more letters match than the two have in
    common as multisets. So a length meets a range of lengths; of each pair of lengths a number of common letters
    is due, `need`; and of two sets with so many elements in common, ordered alike, the first size - need + 1 of
    each share one. These beginnings, rarest letters first, are joined, and the letters of the pairs counted.
    """
    sides = [(side.select(text, _numbered_letters(text).alias("letters")), text) for side, text in ((asked, "asked"), (known, "name"))]
    every = sides[0][0].select(F.explode("letters").alias("letter")).unionAll(sides[1][0].select(F.explode("letters").alias("letter")))
    order = every.groupBy("letter").agg(F.count("*").alias("seen"))
    (a, _), (b, _) = sides
    a = _rare_first(a, "asked", order).withColumn("la", F.length("asked"))
    b = _rare_first(b, "name", order).withColumn("lb", F.length("name"))
    need = F.ceil(cutoff * (F.col("la") + F.col("lb")) / 2 - 1e-6).cast("int")
    # Pairs of lengths that occur, which are few; a side never meets lengths that the other does not have.
    lengths = a.select("la").distinct().join(b.select("lb").distinct(), need <= F.least("la", "lb")).withColumn("need", need)

    def beginnings(side: DataFrame, own: str, text: str, letters: str) -> DataFrame:
        first = F.slice("letters", 1, F.greatest(F.lit(0), F.size("letters") - F.col("need") + 1))
        return side.join(lengths, own).select("la", "lb", "need", text, F.col("letters").alias(letters), F.explode(first).alias("letter"))

    met = beginnings(a, "la", "asked", "letters_a").join(beginnings(b, "lb", "name", "letters_b").drop("need"), ["letter", "la", "lb"])
    return met.where(F.size(F.array_intersect("letters_a", "letters_b")) >= F.col("need")).select("asked", "name").distinct()


def fuzzy_matches(queries: DataFrame, key: str, text: str, names: DataFrame, name: str, cutoff: float = 0.7, min_length: int = 3, top: int = 1) -> DataFrame:
    """(key, match, ratio): the closest of the names by matching blocks, or null under cutoff; of equally close ones the last in order.

    top: so many rows for each query at most, if as many names are close enough.

    Distinct texts meet distinct names, so a text that many rows share is compared once, and only with names that
    candidates lets through. Null texts and those under min_length characters match nothing.
    """
    asked = queries.select(F.col(text).alias("asked")).where(F.length("asked") >= min_length).distinct()
    known = names.select(F.col(name).alias("name")).where(F.length("name") > 0).distinct()

    @F.pandas_udf("double")
    def ratio(listed: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, n, w).ratio() for n, w in zip(listed, wanted, strict=True)], dtype="float64")

    close = candidates(asked, known, cutoff).withColumn("ratio", ratio("name", "asked")).where(F.col("ratio") >= cutoff)
    if top == 1:
        best = close.groupBy("asked").agg(F.max(F.struct("ratio", "name")).alias("m")).select(F.col("asked").alias("_asked"), "m.ratio", F.col("m.name").alias("match"))
    else:
        place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("ratio"), F.desc("name")))
        best = close.withColumn("_place", place).where(F.col("_place") <= top).select(F.col("asked").alias("_asked"), "ratio", F.col("name").alias("match"))
    return queries.join(best, F.col(text) == F.col("_asked"), "left").select(key, "match", F.round("ratio", 6).alias("ratio"))
