"""Which names occur in which texts: Aho-Corasick automata over parts of the names, run over each text where it lies."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters of names that one automaton holds, and automata that texts are run through; beyond that, the join.
PART_CHARS, MOST_PARTS = 1_000_000, 16
#: Lengths of names with one start up to which texts are cut at each start, where names need more than one automaton.
MOST_LENGTHS = 32
WORD_BREAK = r"[^\p{L}\p{N}]+"


def names_in_texts(texts: DataFrame, key: str, wanted: dict[str, DataFrame], longest: tuple[str, ...] = (), part_chars: int = PART_CHARS, most_parts: int = MOST_PARTS, most_lengths: int = MOST_LENGTHS) -> DataFrame:
    """(key, field, name): the names that occur in each text, at any place.

    wanted: for each field (a text column of texts) a table of one column of names. Of the fields in longest only the
    longest name that a text holds, of equally long ones the first in order. Null and empty names occur nowhere.
    key tells texts apart.

    Names are dealt by hash into parts of about part_chars characters. A part's automaton is sent to the tasks,
    which run their texts through it as they read them: no text is exploded or shuffled, and all fields are searched
    in one pass. Names of more than one part are found in one pass too, see cut_at_starts, if they have few starts and
    those with the same start at most most_lengths lengths. Other names take a pass for each part; where they would
    make more than most_parts, each field is joined by parts of the names instead, see joined_by_anchor.
    """
    spark = texts.sparkSession
    needles = None
    for field, names in wanted.items():
        side = names.select(F.lit(field).alias("field"), F.col(names.columns[0]).alias("name")).where(F.length("name") > 0)
        needles = side if needles is None else needles.unionByName(side)
    needles = needles.distinct()
    parts = -(-(needles.agg(F.sum(F.length("name"))).first()[0] or 0) // part_chars)
    starts = _starts(needles, part_chars, most_lengths) if parts > 1 else None
    if starts:
        found = cut_at_starts(texts, key, starts).join(needles, ["field", "name"]).select(key, "field", "name")
        return _longest(found, key, longest) if longest else found
    if parts > most_parts:
        found = None
        for field in wanted:
            hits = joined_by_anchor(texts, key, field, needles.where(F.col("field") == field).select("name"), "name")
            hits = hits.select(key, F.lit(field).alias("field"), "name")
            found = hits if found is None else found.unionByName(hits)
        return _longest(found, key, longest) if longest else found

    schema = T.StructType([texts.schema[key], T.StructField("field", T.StringType()), T.StructField("name", T.StringType())])

    def searched(automata):
        def run(batches):
            for batch in batches:
                keys, hits = batch.column(key), []
                for field, automaton in automata.value.items():
                    for i, text in enumerate(batch.column(field).to_pylist()):
                        names = {name for _, name in automaton.iter(text)} if text else ()
                        if names and field in longest:
                            most = max(map(len, names))
                            names = (min(n for n in names if len(n) == most),)
                        hits += [(i, field, n) for n in names]
                at, fields, names = (list(c) for c in zip(*hits, strict=True)) if hits else ([], [], [])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(fields, pa.string()), pa.array(names, pa.string())], [key, "field", "name"])

        return run

    found = spark.createDataFrame([], schema) if not parts else None
    for part in range(parts):
        automata = {}
        for row in needles.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).collect():
            automata.setdefault(row["field"], ahocorasick.Automaton()).add_word(row["name"], row["name"])
        for automaton in automata.values():
            automaton.make_automaton()
        hits = texts.select(key, *wanted).mapInArrow(searched(spark.sparkContext.broadcast(automata)), schema)
        found = hits if found is None else found.unionByName(hits)
    return _longest(found, key, longest) if longest and parts > 1 else found


def _starts(needles: DataFrame, most_chars: int, most_lengths: int, sizes: tuple[int, ...] = (12, 8, 6, 4, 3, 2, 1)) -> dict[str, dict[str, list[int]]] | None:
    """{field: {start: lengths}} of needles (field, name): the longest starts that have at most most_chars characters together; none if names with the same start have more lengths."""
    for size in sizes:
        starts = needles.select("field", F.left("name", F.lit(size)).alias("start"), F.length("name").alias("n")).groupBy("field", "start").agg(F.collect_set("n").alias("lengths"))
        chars, most = starts.agg(F.sum(F.length("start")), F.max(F.size("lengths"))).first()
        if most > most_lengths:
            return None  # shorter starts have no fewer lengths
        if chars <= most_chars:
            out = {}
            for row in starts.collect():
                out.setdefault(row["field"], {})[row["start"]] = sorted(row["lengths"])
            return out
    return None


def cut_at_starts(texts: DataFrame, key: str, starts: dict[str, dict[str, list[int]]]) -> DataFrame:
    """(key, field, name): of each text, where a start is, the pieces of the lengths that names with this start have; names only after a join with them."""
    automata = {}
    for field, lengths in starts.items():
        automata[field] = ahocorasick.Automaton()
        for start, of in lengths.items():
            automata[field].add_word(start, (len(start) - 1, of))
        automata[field].make_automaton()
    shared = texts.sparkSession.sparkContext.broadcast(automata)

    def run(batches):
        for batch in batches:
            at, fields, names = [], [], []
            for field, automaton in shared.value.items():
                for i, text in enumerate(batch.column(field).to_pylist()):
                    cut = {text[end - back : end - back + n] for end, (back, of) in automaton.iter(text) for n in of if end - back + n <= len(text)} if text else ()
                    at += [i] * len(cut)
                    fields += [field] * len(cut)
                    names += cut
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(fields, pa.string()), pa.array(names, pa.string())], [key, "field", "name"])

    schema = T.StructType([texts.schema[key], T.StructField("field", T.StringType()), T.StructField("name", T.StringType())])
    return texts.select(key, *starts).mapInArrow(run, schema)


def _longest(found: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key, "field").orderBy(F.desc(F.length("name")), "name"))
    return found.withColumn("_r", rank).where(~F.col("field").isin(*fields) | (F.col("_r") == 1)).drop("_r")


def joined_by_anchor(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, anchor: int = 12) -> DataFrame:
    """(key, name) for the names that occur in the texts, by joins; for more names than automata can hold.

    Nothing compares all texts with all names. A name that has words inside, between its first and last
    break, is looked up by the longest of them among the texts' words, which an occurrence must have whole;
    any other name by its first characters, at most anchor, at every place of the texts. Hits are then checked.
    """
    parts = F.split(F.col(name), WORD_BREAK)
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    mine = names.where(F.length(name) > 0).select(F.col(name).alias("name"), longest.alias("word"), F.least(F.length(name), F.lit(anchor)).alias("n")).distinct()
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.col(text), WORD_BREAK))).alias("word"))
    pairs = words.join(mine.where("word is not null").select("name", "word"), "word").select(key, "name")
    for (n,) in mine.where("word is null").select("n").distinct().orderBy("n").collect():
        starts = mine.where((F.col("n") == n) & F.col("word").isNull()).select("name", F.left("name", F.lit(n)).alias("start"))
        spots = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), _starts_at(text, n)))
        grams = texts.select(key, F.explode(F.when(F.length(text) >= n, spots)).alias("start"))
        pairs = pairs.union(grams.join(starts, "start").select(key, "name"))
    return texts.select(key, text).join(pairs.distinct(), key).where(F.col(text).contains(F.col("name"))).select(key, "name")


def _starts_at(text: str, n: int):
    return lambda i: F.substring(F.col(text), i, F.lit(n))
