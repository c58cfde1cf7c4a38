"""Language-model scores with stupid backoff, computed by joins of exploded bigrams and count tables.

Three count tables are built over the whole corpus: words, the bigrams of frequent words, and all other
bigrams, the last one partitioned by the bigram's hash together with the tokens that need it. A bigram of two
frequent words can be as frequent as a word; there are few of them, so they are counted with combining before
the shuffle and joined by broadcast. Any other bigram has a word that is not frequent, so none can fill a task.

Head words, the most frequent ones, have short numbers and are joined by broadcast. All others, the tail, keep
their hashes, and their counts are joined by shuffle to the tokens that ask for them; none is frequent enough to
fill a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored

EDGE = 0  # stands before the first and after the last word
NUMBER_BITS = 29  # of a head word's number
TAIL_BIT = 1 << 62  # set in the hash of a tail word, so that none is a number


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def bigrams(docs: DataFrame) -> DataFrame:
    """(doc_id, p, w): hashes of each word and of the one before it; the edge ends every text."""
    edge = F.array(F.lit(""))
    docs = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # Words are exploded and then hashed, which stays in generated code; a function over the array would not.
    pairs = F.arrays_zip(F.concat(edge, "words").alias("p"), F.concat("words", edge).alias("w"))
    hashed = [F.when(F.col(f"x.{c}") == "", F.lit(EDGE).cast("long")).otherwise(F.xxhash64(f"x.{c}")).alias(c) for c in ("p", "w")]
    return docs.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", *hashed)


def vocabulary(words: DataFrame, head: int, bucket_width: int = 8) -> tuple[DataFrame, DataFrame, int, bool]:
    """(word, n, id) for at most head of the most frequent words, (word, n) for all others, the sum of all n, and whether there are others.

    The cut is a count, found in a histogram of count classes.
    """
    kind = F.floor(F.log2("n") * bucket_width).cast("int")
    classes = words.groupBy(kind.alias("kind")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("kind")).collect()
    taken, cut = 0, None
    for row in classes:
        if taken + row["words"] > head:
            break
        taken, cut = taken + row["words"], row["kind"]
    total = sum(row["n"] for row in classes)
    chosen, others = (words.where(kind >= cut), words.where(kind < cut)) if cut is not None else (words.limit(0), words)
    # The place in a stored file makes a short number for each word.
    place = F.monotonically_increasing_id()
    short = F.shiftleft(F.shiftright(place, 33), 20) + place.bitwiseAND(F.lit((1 << 33) - 1).cast("long")) + 1
    return stored(chosen.repartition(16, "word").select("word", "n", short.alias("id")), "vocabulary"), others, total, taken < sum(row["words"] for row in classes)


def score(docs: DataFrame, frequent: int = 2048, task_rows: int = 1 << 24, min_count: int = 2, backoff: float = 0.4, head: int = 1 << 20) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) for every doc_id of docs (doc_id, text).

    A text's tokens are its lower-cased words and the edge that ends it. A token scores c(p, w) / c(p) if its
    bigram occurs min_count times or more in docs, else backoff * c(w) / N; log_score sums natural logarithms and is
    rounded to 4 digits, as sums of doubles depend on their order.
    Every word and every bigram of docs is counted for itself. Null and empty texts are one edge, and texts of any
    length are read whole. Rows that share a doc_id, or have none, are one document of several texts. An empty
    table gives an empty table. Other columns, whatever their names, are neither read nor returned.

    The other parameters change no score. head bounds the table of words that is broadcast. A word is frequent if
    more than one in `frequent` of all tokens, or more than task_rows tokens, are it: bigrams of two frequent words
    are combined before the shuffle, so no bigram puts more than task_rows tokens into one task. Their counts are
    broadcast if there are at most frequent ** 2 of them, else joined by a shuffle that Spark can split.
    """
    counted = bigrams(docs).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"))
    vocab, others, total, has_tail = vocabulary(stored(counted, "words"), head)
    # Every text has one edge before it and one after it, so the edge is counted as often in either place.
    least = min(total / frequent, task_rows)
    known, often = F.broadcast(vocab), F.broadcast(vocab.where(F.col("n") > least))

    def named(rows: DataFrame, column: str, table: DataFrame, how: str) -> DataFrame:
        side = table.select(F.col("word").alias("_word"), F.col("n").alias(f"n_{column}"), F.col("id").alias(f"id_{column}"))
        return rows.join(side, F.col(column) == F.col("_word"), how).drop("_word")

    def pair_key(p: Column, w: Column) -> Column:
        return F.shiftleft(p, NUMBER_BITS).bitwiseOR(w)

    def logs(c: Column, n_p: Column, n_w: Column) -> Column:
        return F.when(c >= min_count, F.log(c / n_p)).otherwise(F.log(F.lit(backoff) * n_w / F.lit(float(max(1, total)))))

    def frequent_pairs() -> DataFrame:
        return named(named(bigrams(docs), "p", often, "inner"), "w", often, "inner").withColumn("key", pair_key(F.col("id_p"), F.col("id_w")))

    frequent_counts = stored(frequent_pairs().groupBy("key").agg(F.count("*").alias("c"), F.first("n_p").alias("n_p"), F.first("n_w").alias("n_w")), "frequent")
    frequent_scores = frequent_counts.select("key", logs(F.col("c"), F.col("n_p"), F.col("n_w")).alias("s"))
    if frequent_counts.count() <= frequent**2:
        frequent_scores = F.broadcast(frequent_scores)
    hot = frequent_pairs().select("doc_id", "key").join(frequent_scores, "key").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("s").alias("s"))

    def is_frequent(column: str) -> Column:
        return F.coalesce(F.col(f"n_{column}") > least, F.lit(False))

    def identity(column: str) -> Column:
        return F.coalesce(f"id_{column}", F.col(column).bitwiseOR(F.lit(TAIL_BIT)))

    cold = named(named(bigrams(docs), "p", known, "left"), "w", known, "left").where(~(is_frequent("p") & is_frequent("w")))
    cold = cold.select("doc_id", identity("p").alias("p"), identity("w").alias("w"))
    # Two numbers fit one key. A bigram with a tail word has its two identities as key and second, which is not zero then.
    packed = F.col("p").bitwiseOR(F.col("w")).between(0, (1 << NUMBER_BITS) - 1)
    cold = cold.select("doc_id", F.when(packed, pair_key(F.col("p"), F.col("w"))).otherwise(F.col("p")).alias("key"), F.when(packed, F.lit(0).cast("long")).otherwise(F.col("w")).alias("second"))
    # The count table of these bigrams and its join to the tokens, in one partitioning by the bigram's hash.
    cold = cold.withColumn("c", F.count("*").over(Window.partitionBy("key", "second")))
    whole = F.col("second") == 0
    p = F.when(whole, F.shiftright("key", NUMBER_BITS)).otherwise(F.col("key"))
    w = F.when(whole, F.col("key").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1).cast("long"))).otherwise(F.col("second"))
    seen = F.col("c") >= min_count
    sizes = F.broadcast(vocab.select(F.col("id").alias("_id"), F.col("n").alias("_n")))
    cold = cold.select("doc_id", "c", F.when(seen, p).otherwise(w).alias("asked")).join(sizes, F.col("asked") == F.col("_id"), "left")
    n = F.coalesce(F.col("_n"), F.lit(1))
    sums = [F.count("*").alias("n"), F.sum(logs(F.col("c"), n, n)).alias("s")]
    if has_tail:
        # A tail word counts as one at first; the logarithm of its count is added, or taken off where it is the divisor.
        tail = F.when(F.col("_n").isNull(), F.col("asked")).alias("tail")
        part = stored(cold.groupBy("doc_id", tail).agg(*sums, F.sum(F.when(seen, -1).otherwise(1)).alias("times")), "cold")
        counts = others.select(F.col("word").bitwiseOR(F.lit(TAIL_BIT)).alias("tail"), F.col("n").alias("n_tail"))
        looked_up = part.where("tail is not null").join(counts, "tail").select("doc_id", "n", (F.col("s") + F.col("times") * F.log("n_tail")).alias("s"))
        cold = part.where("tail is null").select("doc_id", "n", "s").union(looked_up)
    else:
        cold = cold.groupBy("doc_id").agg(*sums)
    both = hot.union(cold).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("s").alias("s"))
    return both.select("doc_id", "n_tokens", F.round("s", 4).alias("log_score"), F.round(F.col("s") / F.col("n_tokens"), 6).alias("mean_log_score"))
