"""Benchmark decontamination by winnowing, in DataFrame operations only.

Both sides are cut into words; the smallest of every `span - k + 1` neighbouring k-gram hashes is kept as a
fingerprint. Two texts that share `span` words in a row keep the same fingerprint there, so an equi-join of
fingerprints misses no shared span. A joined pair carries the words around its k-gram; comparing them outward
extends the hit and drops those under `span` words, so chance equality of hashes decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators, after and before A-Z are lower-cased.
SEPARATORS, CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of a-z, 0-9 and non-ASCII characters. Null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(CASED_SEPARATORS)), F.lit(0)).cast("long")


def fingerprints(df: DataFrame, keys: list[str], span: int, totals: bool = False) -> DataFrame:
    """Rows (keys..., fp, n_before, at, around) of df (keys..., words) for its winnowed k-grams.

    around has the k-gram's words and up to span - k words on either side; n_before of them stand before it.
    Rows of fewer than span words give none. totals: one more row each, without fp, whose `at` counts the words.
    """
    k = min(5, span)
    reach = span - k

    # A k-gram is its hash above its place, so that a window's smallest value names its winner and where it stands.
    def gram(i: Column) -> Column:
        return F.shiftleft(F.xxhash64(*[F.element_at("words", i + j) for j in range(k)]), 32).bitwiseOR(i.cast("long"))

    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), gram)
    df = df.select(*keys, "words", F.when(F.size("words") >= span, grams).alias("grams"))
    winners = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("grams") - reach), lambda i: F.array_min(F.slice("grams", i, reach + 1))))

    def row(winner: Column) -> Column:
        p = winner.bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int")
        return F.struct(
            F.shiftright(winner, 32).alias("fp"),
            F.least(p - 1, F.lit(reach)).alias("n_before"),
            p.alias("at"),
            F.slice("words", F.greatest(p - reach, F.lit(1)), F.least(p - 1, F.lit(reach)) + span).alias("around"),
        )

    rows = F.when(F.col("grams").isNotNull(), F.transform(winners, row))
    if totals:
        total = F.struct(F.lit(None).cast("long").alias("fp"), F.lit(0).alias("n_before"), F.size("words").alias("at"), F.slice("words", 1, 0).alias("around"))
        rows = F.concat(F.coalesce(rows, F.slice(F.array(total), 1, 0)), F.array(total))
    df = df.select(*keys, F.explode(rows).alias("x"))
    return df.select(*keys, "x.fp", "x.n_before", "x.at", "x.around")


def _common(n: int, mine, yours) -> Column:
    """How many of n neighbours agree in a row, given each side's word at distance 1..n (null past its end)."""
    found = F.lit(n)
    for d in range(n, 0, -1):
        found = F.when(mine(d).isNull() | yours(d).isNull() | (mine(d) != yours(d)), F.lit(d - 1)).otherwise(found)
    return found


def extended_hits(docs: DataFrame, theirs: DataFrame, span: int, totals: bool = False) -> DataFrame:
    """(doc, n_words, items, run) for the runs of at least span words around joined fingerprints.

    docs has (doc, words); theirs has the items' unlike fingerprints (items: ids that share it, fp, n_before,
    around), so a passage of many items is compared once. Words count from 1. n_words is null but in the rows that totals adds, one for each of docs, which have no run.
    """
    k = min(5, span)
    reach = span - k
    theirs = theirs.select("items", "fp", F.col("n_before").alias("item_before"), F.col("around").alias("item_around"))
    mine = fingerprints(docs, ["doc"], span, totals).withColumnRenamed("fp", "own")
    joined = mine.join(F.broadcast(theirs), F.col("own") == F.col("fp"), "left" if totals else "inner")

    def word(side: str, before: str, offset: int) -> Column:
        return F.try_element_at(side, F.when(F.col(before) + offset > 0, F.col(before) + offset))

    same = F.slice("around", F.col("n_before") + 1, k) == F.slice("item_around", F.col("item_before") + 1, k)
    left = _common(reach, lambda d: word("around", "n_before", 1 - d), lambda d: word("item_around", "item_before", 1 - d))
    right = _common(reach, lambda d: word("around", "n_before", k + d), lambda d: word("item_around", "item_before", k + d))
    # Without fp there is nothing to compare; and in one expression the join looks for equal fingerprints alone.
    run = F.when(F.col("fp").isNotNull(), F.when(same, F.struct((F.col("at") - left).alias("first"), (F.col("at") + k - 1 + right).alias("last"))))
    n_words = F.when(F.col("own").isNull(), F.col("at")).cast("long")
    joined = joined.select("doc", n_words.alias("n_words"), "items", run.alias("run"))
    return joined.where((F.col("run.last") - F.col("run.first") + 1 >= span) | F.col("n_words").isNotNull()).select("doc", "n_words", "items", "run")


def _covered(spans: Column) -> Column:
    """Number of words inside the union of sorted (first, last) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(acc["end"], s["first"] - 1))).alias("n"), F.greatest(acc["end"], s["last"]).alias("end")
    )
    return F.aggregate(spans, start, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, span: int = 13, one_in: int = 20, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs (doc_id, text).

    A window is span consecutive words of an item (item_id, text); an item of fewer words, but not none, is one
    window. A document's word inside any occurrence of a window is hit; contaminated: the hit words are some, and
    one in one_in of its words at least. The items' fingerprints are broadcast in blocks of those of about
    block_words words, which bounds a block whatever the table's size; each block passes over the documents
    once, and items shorter than span once for each of their lengths. Null and empty texts have no words, and
    texts of any length are read whole; repeated rows of a document get the same result each, and rows of one
    doc_id with unlike texts each their own; items that share an item_id count once; items without words never hit;
    those without an id hit, but n_items and items_sha256 leave them out; an empty table of items hits nothing, and one of documents gives an empty table. Other columns,
    whatever their names, are neither read nor returned.
    """
    out = judged(docs, items, span, one_in, block_words)
    return out.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def judged(docs: DataFrame, items: DataFrame, span: int = 13, one_in: int = 20, block_words: int = 1_000_000) -> DataFrame:
    """contamination with doc, struct<doc_id, h: hash of the text>, in place of doc_id."""
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    words = docs.select(key.alias("doc"), words_of(F.col("text")).alias("words"))
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    asked = asked.withColumn("span", F.least(F.size("words"), F.lit(span))).where("span > 0")
    found = None
    for length, n_words in sorted(map(tuple, asked.groupBy("span").agg(F.sum(F.size("words"))).collect())):
        theirs = fingerprints(asked.where(F.col("span") == length), ["item_id"], length)
        theirs = theirs.groupBy("fp", "n_before", "around").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        blocks = -(-n_words // block_words)
        for b in range(blocks):
            block = theirs.where(F.pmod(F.xxhash64("fp", "around"), F.lit(blocks)) == b) if blocks > 1 else theirs
            hits = extended_hits(words, block, length, found is None)
            found = hits if found is None else found.union(hits)
    if found is None:
        base = docs.select(key.alias("doc"), count_words(F.col("text")).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("ids"))
    else:
        # A document's totals are counted, as repeated rows of it come back as often.
        per_doc = found.groupBy("doc").agg(
            F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set("run")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
        )
        base = per_doc.select(
            "doc", "n_words", _covered(F.col("runs")).alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))),
        )
    bad = (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))
    return base.select("doc", "n_words", "n_hit", "n_items", F.sha2("ids", 256).alias("items_sha256"), bad.alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs with all columns, less the rows that contamination marks; rows are told apart by doc_id and text."""
    bad = judged(docs.select("doc_id", "text"), items, **options).where("contaminated").select("doc").distinct()
    bad = bad.select(F.col("doc.doc_id").alias(i := unused("id", docs)), F.col("doc.h").alias(h := unused("hash", docs)))
    # Stored, so that the join is planned with the size of what goes, which is small as a rule.
    return docs.join(stored(bad, "contaminated"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_anti")
