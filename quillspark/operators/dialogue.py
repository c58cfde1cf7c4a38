"""What stands between a question and an answer: intents, card decisions, reviews by a model, contexts and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def has_intent(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words at any place, also inside a run of letters."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(words))


def narrowed(candidates: DataFrame, key: str, teaches: DataFrame, teacher: str, course: str | None, college: str | None) -> DataFrame:
    """candidates (key, teacher, college, asked_course, asked_college) that teach the asked course or are of the asked college.

    Without either question, or where it would leave no one, all stay.
    """
    known = teaches.select(F.col(teacher).alias("_t"), F.col("course").alias("_c"), F.lit(True).alias("_fit")).distinct()
    joined = candidates.join(known, (F.col(teacher) == F.col("_t")) & (F.col(course or "asked_course") == F.col("_c")), "left")
    of_college = F.coalesce(F.col("college").contains(F.col(college or "asked_college")), F.lit(False))
    joined = joined.withColumn("_ok", F.coalesce("_fit", F.lit(False)) | of_college)
    some = F.bool_or("_ok").over(Window.partitionBy(key))
    return joined.withColumn("_some", some).where("_ok OR NOT _some").drop("_t", "_c", "_fit", "_ok", "_some")


def decide(questions: DataFrame, key: str, teachers: DataFrame, courses: DataFrame) -> DataFrame:
    """(key, kind) of questions by their matches: teacher card, course card, course choice, ambiguous or none.

    teachers and courses are (key, match) tables. One teacher makes a card whatever the courses; several are
    ambiguous; without a teacher one course makes a card and several a choice.
    """
    t = teachers.groupBy(key).agg(F.count_distinct("match").alias("_t"))
    c = courses.groupBy(key).agg(F.count_distinct("match").alias("_c"))
    rows = questions.select(key).join(t, key, "left").join(c, key, "left")
    n, m = F.coalesce("_t", F.lit(0)), F.coalesce("_c", F.lit(0))
    return rows.select(key, F.when(n == 1, "teacher").when(n > 1, "ambiguous").when(m == 1, "course").when(m > 1, "choose").otherwise("none").alias("kind"))


def strong_signal(comments: DataFrame, key: str, name: Column, text: Column, phrases: list[str], college: str) -> DataFrame:
    """Keys whose comments say that the name is shared, by a phrase anchored on it, or report two colleges or more."""
    says = F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: text.contains(F.replace(p, F.lit("{}"), name)))
    reported = F.regexp_extract_all(text, F.lit(college), 1)
    rows = comments.select(key, says.alias("says"), F.explode_outer(reported).alias("college"))
    found = rows.groupBy(key).agg(F.bool_or("says").alias("says"), F.count_distinct("college").alias("colleges"))
    return found.where("says OR colleges >= 2")


def cluster_assignment(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, comment_id, cluster) of model answers `{"clusters": [[ids...], ...]}`; what is malformed assigns nothing.

    A comment that is listed twice belongs to the first cluster.
    """
    parsed = F.from_json(F.regexp_extract(F.col(answer), r"(?s)(\{.*\})", 1), "clusters array<array<long>>")["clusters"]
    rows = answers.select(key, F.posexplode(parsed).alias("cluster", "ids")).select(key, "cluster", F.explode("ids").alias("comment_id"))
    return rows.groupBy(key, "comment_id").agg(F.min("cluster").alias("cluster"))


def reviewed(comments: DataFrame, id: str, text: str, answers: DataFrame) -> DataFrame:
    """comments with verdict and shown text by model answers (id, answer `{"verdict": ..., "text": ...}`).

    keep shows the comment, junk nothing, sanitized the model's text; any other or missing answer keeps the comment.
    """
    parsed = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), "verdict string, text string")
    known = answers.select(F.col(id).alias("_id"), parsed.alias("_a"))
    joined = comments.join(known, F.col(id) == F.col("_id"), "left")
    clean = F.nullif(F.trim("_a.text"), F.lit(""))
    verdict = F.when(F.col("_a.verdict") == "junk", "junk").when((F.col("_a.verdict") == "sanitized") & clean.isNotNull(), "sanitized").otherwise("keep")
    joined = joined.withColumn("verdict", verdict)
    return joined.withColumn("shown", F.when(F.col("verdict") == "keep", F.col(text)).when(F.col("verdict") == "sanitized", clean)).drop("_id", "_a")


NO_EVIDENCE = "No evidence was found."


def contexts(hits: DataFrame, query: str, place: str, title: str, url: str, text: str, questions: DataFrame) -> DataFrame:
    """(query, n_sources, context): hits in order, numbered by first appearance of their (title, url); or the note that there is none."""
    first = F.min(place).over(Window.partitionBy(query, title, url))
    numbered = hits.withColumn("_first", first).withColumn("_n", F.dense_rank().over(Window.partitionBy(query).orderBy("_first")))
    line = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), F.col(title), F.lit("\n"), F.col(text))
    listed = F.array_sort(F.collect_list(F.struct(place, line.alias("line"))))
    made = numbered.groupBy(query).agg(F.max("_n").alias("n_sources"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("context"))
    return questions.select(query).join(made, query, "left").select(query, F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("context", F.lit(NO_EVIDENCE)).alias("context"))


def allowed_email(address: Column, domains: list[str]) -> Column:
    """Exactly one @, something before it, and a listed domain after it."""
    parts = F.split(F.lower(F.trim(F.coalesce(address, F.lit("")))), "@")
    return (F.size(parts) == 2) & (F.element_at(parts, 1) != "") & F.try_element_at(parts, F.lit(2)).isin(domains)


def edited(terms: DataFrame, edits: DataFrame, known: DataFrame) -> DataFrame:
    """(term, type, names) after edits (seq, action set|delete, term, type, names): the last edit of a term counts.

    A deletion only touches a term of its own type; a setting keeps the names that known (name) has, and without
    any of them changes nothing.
    """
    asked = edits.select("seq", "action", "term", "type", F.explode_outer("names").alias("name")).join(known.select("name", F.lit(True).alias("_k")).distinct(), "name", "left")
    kept = asked.groupBy("seq", "action", "term", "type").agg(F.array_sort(F.collect_list(F.when(F.col("_k"), F.col("name")))).alias("names"))
    valid = kept.where("action = 'delete' OR size(names) > 0")
    last = valid.groupBy("term").agg(F.max_by(F.struct("action", "type", "names"), "seq").alias("e"))
    rows = terms.select("term", F.struct("type", "names").alias("old")).join(last, "term", "full_outer")
    gone = (F.col("e.action") == "delete") & F.col("e.type").eqNullSafe(F.col("old.type"))
    is_set = F.coalesce(F.col("e.action") == "set", F.lit(False))
    rows = rows.where(~F.coalesce(gone, F.lit(False)) & (is_set | F.col("old").isNotNull()))
    return rows.select("term", F.when(is_set, F.col("e.type")).otherwise(F.col("old.type")).alias("type"), F.when(is_set, F.col("e.names")).otherwise(F.col("old.names")).alias("names"))
