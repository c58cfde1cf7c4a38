"""Rating analytics: comment weights, cards, course candidates, mixed profiles and comment quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR_SECONDS = 31557600.0
DECAY = 0.35


def comment_weight(votes: Column, published: Column, now: int, decay: float = DECAY) -> Column:
    """Log-compressed net votes times exp(-decay * age in years); ages under zero count as zero. Times are in seconds."""
    votes = votes.cast("double")
    vote = F.when(votes > 0, 1 + F.log2(1 + votes)).when(votes < 0, 1 - F.log2(1 - votes)).otherwise(1.0)
    age = F.greatest(F.lit(0.0), (F.lit(now) - published) / F.lit(YEAR_SECONDS))
    return vote * F.exp(-F.lit(decay) * age)


def top_comments(comments: DataFrame, teacher: str, cluster: str, weight: str, tie: list[str], first: int = 60, per_cluster: int = 3) -> DataFrame:
    """Of each teacher's `first` heaviest comments the per_cluster heaviest of each cluster; a null cluster is cluster 0.

    Clusters absent from the first comments vanish. tie makes the order total. Both ranks are limited inside
    each partition before they are shuffled.
    """
    order = [F.desc(weight), *tie]
    overall = comments.withColumn("_r", F.row_number().over(Window.partitionBy(teacher).orderBy(*order))).where(F.col("_r") <= first).drop("_r")
    overall = overall.withColumn("cluster", F.coalesce(F.col(cluster).cast("string"), F.lit("0")))
    rank = F.row_number().over(Window.partitionBy(teacher, "cluster").orderBy(*order))
    return overall.withColumn("rank", rank).where(F.col("rank") <= per_cluster)


def cards(teachers: DataFrame, courses: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """One nested row per teacher: courses by (sample_open, sample_count) descending and clusters of ranked comments.

    comments is what top_comments returned, with an `id`; courses has (key, name, sample_open, sample_count).
    """
    listed = F.array_sort(F.collect_list(F.struct((-F.col("sample_open")).alias("a"), (-F.col("sample_count")).alias("b"), "name")))
    by_course = courses.groupBy(key).agg(F.transform(listed, lambda c: c["name"]).alias("courses"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "id")))
    by_cluster = comments.groupBy(key, "cluster").agg(F.transform(ranked, lambda c: c["id"]).alias("ids"))
    clusters = by_cluster.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cluster", "ids"))).alias("clusters"))
    return teachers.join(by_course, key, "left").join(clusters, key, "left")


def course_candidates(teaches: DataFrame, names: list[str], key: str) -> DataFrame:
    """Teachers of any of the named courses, once each, with the names that they teach."""
    found = teaches.where(F.col("course").isin(names)).groupBy(key, "teacher", "rating", "rating_count")
    return found.agg(F.array_sort(F.collect_set("course")).alias("courses"))


def rated_first(df: DataFrame, tie: str, step: float = 1.0) -> DataFrame:
    """df with `place`: rated ones first, by rating, then by number of ratings and tie.

    Rows are numbered inside ranges of ratings, `step` wide, and moved up by the ranges before; so what one task
    sees is a range, or the table of the ranges' counts. A null rating comes last among its kind.
    """
    ranged = df.withColumn("_rated", F.coalesce(F.col("rating_count") > 0, F.lit(False))).withColumn("_range", F.coalesce(F.floor(F.col("rating") / step).cast("double"), F.lit(float("-inf"))))
    before = Window.orderBy(F.desc("_rated"), F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_rated", "_range").count().select("_rated", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_rated", "_range").orderBy(F.desc("rating"), F.desc("rating_count"), tie))
    placed = ranged.withColumn("_within", within).join(counts, ["_rated", "_range"])
    return placed.withColumn("place", (F.col("_before") + F.col("_within")).cast("int")).drop("_rated", "_range", "_within", "_before")


def divergent(comments: DataFrame, key: str, votes: str, threshold: float, min_comments: int = 10, each_side: int = 2) -> DataFrame:
    """Keys with min_comments comments or more of which each_side or more are above threshold and as many below -threshold."""
    counts = comments.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(votes) > threshold).alias("above"), F.count_if(F.col(votes) < -threshold).alias("below"))
    return counts.where((F.col("n") >= min_comments) & (F.col("above") >= each_side) & (F.col("below") >= each_side))


def strongest_reason(reasons: list[tuple[DataFrame, str, int]], key: str) -> DataFrame:
    """(key, reason) with the reason of highest priority, of (keys, reason, priority) tables."""
    rows = None
    for keys, reason, priority in reasons:
        part = keys.select(key, F.lit(reason).alias("reason"), F.lit(priority).alias("priority")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.max_by("reason", "priority").alias("reason"))


def extremes(comments: DataFrame, key: str, votes: str, tie: list[str], n: int = 2) -> DataFrame:
    """Each key's n most positive and n most negative comments with side and rank; positive ones have votes over zero."""
    up = Window.partitionBy(key).orderBy(F.desc(votes), *tie)
    down = Window.partitionBy(key).orderBy(F.asc(votes), *tie)
    positive = comments.where(F.col(votes) > 0).withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= n).withColumn("side", F.lit("positive"))
    negative = comments.where(F.col(votes) < 0).withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= n).withColumn("side", F.lit("negative"))
    return positive.unionByName(negative)


#: Fixed values of the comment rules: short words that are an opinion, insults, and roots of opinions.
SHORT_OK = ["好", "赞", "棒", "强", "差", "坑", "水", "ok", "gd"]
BAD_WORDS = ["idiot", "clown", "scum", "moron", "worthless", "pathetic", "loser", "stupid", "trash", "disgusting"]
OPINION_ROOTS = ["teach", "class", "exam", "homework", "grade", "course", "good", "bad", "kind", "strict"]


def comment_quality(text: Column, short_ok: list[str] = SHORT_OK, bad_words: list[str] = BAD_WORDS, roots: list[str] = OPINION_ROOTS) -> Column:
    """0 keep, 1 junk, 2 to be reviewed.

    Empty texts and those of under two letters or digits are junk, unless the letter is an opinion by itself.
    Without a bad word a text is kept. Bad words are taken out longest first; nothing left, or under eight
    letters without an opinion's root, is junk; with a root it is kept; else it is reviewed.
    """
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    text = F.trim(F.coalesce(text, F.lit("")))
    rest = text
    hit = F.lit(False)
    for word in sorted(bad_words, key=lambda w: (-len(w), w)):
        hit = hit | text.contains(word)
        rest = F.replace(rest, F.lit(word), F.lit(""))
    says = F.lit(False)
    for root in roots:
        says = says | rest.contains(root)
    return (
        F.when(text == "", 1).when(F.length(bare(text)) < 2, F.when(bare(text).isin(short_ok), 0).otherwise(1)).when(~hit, 0)
        .when(bare(rest) == "", 1).when(says, 0).when(F.length(bare(rest)) < 8, 1).otherwise(2)
    )


def concatenated(rows: DataFrame, key: str, text: str, order: list[str], between: str = "") -> DataFrame:
    """(key, text): all texts of a key one after the other, in the given order; null texts are left out.

    A key's text is one value, so it has to fit a row; keys meet in one shuffle, sorted there.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, F.col(text).alias("_text")))))
    return rows.groupBy(key).agg(F.array_join(listed["_text"], between).alias(text))
