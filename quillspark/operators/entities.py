"""Entity lookup: containment, prefix and fuzzy joins, resolver chains, mentions and slang."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.containment import names_in_texts
from quillspark.operators.fuzzy import fuzzy_matches


def contained_names(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, **limits) -> DataFrame:
    """(key, name, length) for the names that occur in the texts; see containment.names_in_texts for how and its limits."""
    return names_in_texts(texts, key, {text: names.select(name)}, **limits).select(key, "name", F.length("name").alias("length"))


def longest_contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, **limits) -> DataFrame:
    """(key, name, length): the longest name that each text holds; of equal ones the first in order."""
    return names_in_texts(texts, key, {text: names.select(name)}, (text,), **limits).select(key, "name", F.length("name").alias("length"))


def by_prefix(questions: DataFrame, key: str, text: str, courses: DataFrame, course: str, n: int = 4, max_hits: int = 20, slang: Column | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, course, exact): the names that a question holds and those of its slang, else the longest name whose first n letters it holds.

    Names and first letters count at any place and across breaks, without regard to case; a name under n letters
    only as a whole. slang: the names that a question's slang stands for, an array over columns of questions (see
    expand_slang); they are exact. A question that more than max_hits names fit by prefix gets none of these.

    A start stands for its names by their number and the longest, so a question's rows are what it holds, not the names
    that fit. keep stores the table of what is looked up, whose size is known then: a small one is sent to the rows.
    """
    asked = questions.select(key, F.lower(text).alias("_text"), (F.array().cast("array<string>") if slang is None else slang).alias("_slang"))
    names = courses.select(F.col(course).alias("course")).where(F.col(course).isNotNull()).distinct()
    whole = names.groupBy(F.lower("course").alias("name")).agg(F.collect_list("course").alias("courses"))
    starts = names.where(F.length("course") >= n).groupBy(F.lower(F.left("course", F.lit(n))).alias("name")).agg(F.count("*").alias("n"), F.min(F.struct((-F.length("course")).alias("longest_first"), "course")).alias("best"))
    forms = keep(whole.join(starts, "name", "full"))
    held = names_in_texts(asked, key, {"_text": forms.select("name")}).join(forms, "name").select(key, F.struct("name", "courses", "n", "best").alias("hit"))
    known = forms.select(F.explode("courses").alias("course"))
    meant = asked.select(key, F.explode("_slang").alias("course")).join(known, "course", "left_semi")
    none = lambda field: F.lit(None).cast(forms.schema[field].dataType).alias(field)
    meant = meant.select(key, F.struct(none("name"), F.array("course").alias("courses"), none("n"), none("best")).alias("hit"))
    # A name that is found is a start's, too, but counts once.
    per = held.unionByName(meant).groupBy(key).agg(F.collect_set("hit").alias("hits"))
    exact = F.array_distinct(F.flatten(F.filter("hits.courses", lambda c: c.isNotNull())))
    fit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + F.coalesce(h["n"], F.lit(0).cast("long")))
    per = per.select(key, exact.alias("exact"), fit.alias("fit"), F.array_min("hits.best")["course"].alias("best"))
    named = lambda c, is_exact: F.struct(c.alias("course"), F.lit(is_exact).alias("exact"))
    close = F.when(F.col("fit").between(1, max_hits), F.array(named(F.col("best"), False)))
    return per.select(key, F.inline(F.when(F.size("exact") > 0, F.transform("exact", lambda c: named(c, True))).otherwise(close)))


SURNAME = "([一-龥]{1,2})老师"


def match_in_text(texts: DataFrame, key: str, text: str, people: DataFrame, id: str, name: str, pinyin: str, initials: str, weak: Column | None = None) -> DataFrame:
    """(key, id, step): the people a text may mean, by the first of four steps that finds any.

    name: the longest name that the text holds, of equally long ones the first in order. surname: all longer names
    that begin with the one or two characters before 老师. pinyin, then initials: all that the lower-cased text
    holds, unless weak (a column of texts, such as that a course's slang is in them) is false for the text.

    Names, pinyin and initials are found in one pass over the texts.
    """
    low = F.lower(text) if weak is None else F.when(weak, F.lower(text))
    searched = texts.select(key, F.col(text).alias("_text"), low.alias("_low"))
    of = lambda column, field, at: people.select(F.lit(field).alias("field"), F.col(column).alias("name"), id, F.lit(column).alias("step"), F.lit(at).alias("_at"))
    known = of(name, "_text", 0).unionByName(of(pinyin, "_low", 2)).unionByName(of(initials, "_low", 3)).where("name <> ''").distinct()
    known = known.withColumn("step", F.when(F.col("_at") == 0, "name").otherwise(F.col("step")))
    wanted = {field: known.where(F.col("field") == field).select("name") for field in ("_text", "_low")}
    found = names_in_texts(searched, key, wanted, ("_text",)).join(known, ["field", "name"]).select(key, id, "step", "_at")
    called = texts.select(key, F.regexp_extract(F.coalesce(text, F.lit("")), SURNAME, 1).alias("called")).where("called <> ''")
    starts = people.select(id, name, F.explode(F.array_distinct(F.array(F.left(name, F.lit(1)), F.left(name, F.lit(2))))).alias("called"))
    by_surname = called.join(starts.where(F.length(name) > F.length("called")), "called").select(key, id, F.lit("surname").alias("step"), F.lit(1).alias("_at"))
    rows = found.unionByName(by_surname).distinct().withColumn("_first", F.min("_at").over(Window.partitionBy(key)))
    return rows.where("_at = _first").select(key, id, "step")


def course_in_text(texts: DataFrame, key: str, text: str, candidates: DataFrame, teaches: DataFrame, id: str, course: str) -> DataFrame:
    """(key, course, own): the longest course that the text holds among those of its candidates (key, id), else among all.

    teaches (id, course). Of equally long ones the first in order. own: whether a candidate teaches it.
    """
    held = contained_names(texts, key, text, teaches, course).select(key, F.col("name").alias(course))
    # The few courses that a text holds are looked up among those of its candidates, not all of the latter listed.
    taught = teaches.select(id, course).distinct().withColumn("_own", F.lit(True))
    held = held.join(candidates.select(key, id).distinct(), key, "left").join(taught, [id, course], "left")
    best = F.min(F.struct(F.col("_own").isNull().alias("other"), (-F.length(course)).alias("longest_first"), F.col(course).alias("course")))
    return held.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.course").alias(course), (~F.col("_b.other")).alias("own"))


def detect(texts: DataFrame, key: str, text: str, intent: Column, people: DataFrame, id: str, name: str, pinyin: str, initials: str, teaches: DataFrame, course: str, slang: Column | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, name, course, candidates) of the texts that judge a person: with the intent, and someone found in them.

    candidates: the ids that match_in_text finds, ascending; name: the first one's. course: course_in_text, or null.
    slang: the courses that a text's slang stands for; with any, pinyin and initials, which are weak signs, do not count.
    keep stores what is read several times: the texts with the intent, who teaches what, and what match_in_text finds.
    """
    slang = None if slang is None else slang.alias("_slang")
    asking = keep(texts.where(intent).select(key, F.col(text), *([] if slang is None else [slang])))
    teaches = keep(teaches.select(id, course).distinct())
    found = keep(match_in_text(asking, key, text, people, id, name, pinyin, initials, None if slang is None else F.size("_slang") == 0))
    meant = found.join(people.select(id, F.col(name).alias("name")), id).groupBy(key).agg(F.min(F.struct(id, "name"))["name"].alias("name"), F.array_sort(F.collect_set(id)).alias("candidates"))
    held = course_in_text(asking, key, text, found, teaches, id, course)
    return meant.join(held.select(key, course), key, "left").select(key, "name", course, "candidates")


def resolve(queries: DataFrame, key: str, chain: list[tuple[str, str, DataFrame]], fuzzy: tuple[str, DataFrame] | None = None, top: int = 5, cutoff: float = 0.7) -> DataFrame:
    """(key, id, step): the first step of chain that knows the query; of several ids of a step the smallest.

    A step is (its name, the column of queries to look up, a table (term, id)). fuzzy: (a column of queries, a table
    (term, id)) for queries that no step knows; these get a row for each id of the `top` closest terms, see
    fuzzy_matches, with step `fuzzy`.
    """
    out = queries
    ids, steps = [], []
    for at, (step, column, table) in enumerate(chain):
        side = table.groupBy(F.col("term").alias(f"_t{at}")).agg(F.min("id").alias(f"_i{at}"))
        out = out.join(side, F.col(column) == F.col(f"_t{at}"), "left")
        ids.append(F.col(f"_i{at}"))
        steps.append(F.when(F.col(f"_i{at}").isNotNull(), step))
    out = out.withColumn("_id", F.coalesce(*ids)).withColumn("_step", F.coalesce(*steps, F.lit("none")))
    known = out.select(key, F.col("_id").alias("id"), F.col("_step").alias("step"))
    if fuzzy is None:
        return known
    column, table = fuzzy
    close = fuzzy_matches(out.where("_id is null"), key, column, table, "term", cutoff, top=top).where("match is not null")
    found = close.join(table.select(F.col("term").alias("match"), "id"), "match").select(key, "id", F.lit("fuzzy").alias("step")).distinct()
    rest = known.join(found.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return rest.unionByName(found)


def mentions(text: Column, term: Column) -> Column:
    """How often term occurs in text without overlap."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")).otherwise(0)


def expand_slang(text: Column, slang: dict[str, list[str]], known: list[str]) -> Column:
    """Names that the slang terms in a text stand for: all occurrences, longest terms first and then by place, none that overlap.

    slang and known are configured lists. Names that are not known are left out.
    """
    spots = []
    for term, named in slang.items():
        names = F.array(*[F.lit(x) for x in named if x in known]).cast("array<string>")
        spots.append(F.transform(_places(text, term), _spot(len(term), names)))
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("taken"), F.array().cast("array<array<string>>").alias("chosen"))
    return F.flatten(F.aggregate(F.array_sort(F.concat(*spots)), start, _take)["chosen"])


def _spot(n: int, names: Column):
    return lambda s: F.struct(F.lit(-n).alias("longest_first"), s.alias("s"), (s + n).alias("e"), names.alias("names"))


def _places(text: Column, term: str) -> Column:
    """Where term occurs in text without overlap, from the lengths of the pieces between occurrences."""
    pieces = F.split(text, r"\Q" + term + r"\E", -1)
    between = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, piece: Column) -> Column:
        here = acc["next"] + F.length(piece)
        return F.struct((here + len(term)).alias("next"), F.concat(acc["at"], F.array(here)).alias("at"))

    return F.aggregate(between, start, step)["at"]


def _take(acc: Column, spot: Column) -> Column:
    """Takes an occurrence unless it overlaps one that was taken."""
    free = ~F.exists(acc["taken"], lambda o: (spot["s"] < o["e"]) & (spot["e"] > o["s"]))
    own = F.array(F.struct(spot["s"].alias("s"), spot["e"].alias("e")))
    return F.struct(
        F.when(free, F.concat(acc["taken"], own)).otherwise(acc["taken"]).alias("taken"),
        F.when(free, F.concat(acc["chosen"], F.array(spot["names"]))).otherwise(acc["chosen"]).alias("chosen"),
    )


def expand_query(text: Column, formal: dict[str, str]) -> Column:
    """text with the formal terms of the slang that it holds appended, in the dictionary's order, unless it has them."""
    extra = F.array_compact(F.array(*[F.when(text.contains(s) & ~text.contains(f), F.lit(f)) for s, f in formal.items()]))
    return F.when(F.size(extra) > 0, F.concat(text, F.lit(" "), F.array_join(extra, " "))).otherwise(text)
