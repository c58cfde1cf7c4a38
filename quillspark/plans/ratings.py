"""Rating queries: suppliers as teachers, parts as courses, line items as comments (quantity less 25 as net votes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import dialogue, entities, fuzzy, ratings
from quillspark.sources.tables import load
from quillspark.streaming.usage import keeper

NOW = 1009843200  # 2002-01-01
TIE = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]


def comments(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    votes = (F.col("l_quantity") - 25).alias("votes")
    weight = ratings.comment_weight(F.col("l_quantity") - 25, F.unix_timestamp(F.col("l_shipdate").cast("timestamp")), NOW)
    return lines.select(*TIE, "l_suppkey", "l_returnflag", "l_linestatus", votes, weight.alias("weight"))


def comment_weight(spark, sf_dir):
    rows = comments(spark, sf_dir)
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total_weight"), F.round(F.max("weight"), 6).alias("top_weight"))


def rating_card(spark, sf_dir):
    rows = comments(spark, sf_dir).where("l_linestatus = 'O'").withColumn("w", F.round("weight", 9))
    top = ratings.top_comments(rows, "l_suppkey", "l_returnflag", "w", TIE)
    return top.select("l_suppkey", "cluster", "rank", "l_orderkey", "l_partkey", F.round("weight", 6).alias("weight"))


def rating_card_nested(spark, sf_dir):
    rows = comments(spark, sf_dir).where("l_linestatus = 'O'").withColumn("w", F.round("weight", 9))
    top = ratings.top_comments(rows, "l_suppkey", "l_returnflag", "w", TIE).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    taught = rows.join(parts, "l_partkey").groupBy("l_suppkey", F.col("p_brand").alias("name")).agg(F.count("*").alias("sample_count"))
    taught = taught.withColumn("sample_open", F.when(F.col("sample_count") >= 15, 1).otherwise(0))
    teachers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    found = ratings.cards(teachers, taught, top, "l_suppkey")
    listed = F.transform("clusters", lambda c: F.concat(c["cluster"], F.lit(":"), F.array_join(c["ids"], "/")))
    return found.select("l_suppkey", "s_name", F.array_join("courses", ",").alias("courses"), F.array_join(listed, ";").alias("clusters"))


def course_candidates(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("course"))
    teachers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("teacher"), F.round("s_acctbal", 2).alias("rating"), F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("rating_count"))
    teaches = lines.join(parts, "l_partkey").join(teachers, "l_suppkey")
    found = ratings.course_candidates(teaches, ["Brand#11", "Brand#23", "Brand#45"], "l_suppkey")
    found = ratings.rated_first(found, "l_suppkey")
    return found.select("l_suppkey", "teacher", "rating", F.array_join("courses", ",").alias("courses"), F.when(F.size("courses") > 1, "choose").otherwise("card").alias("kind"), "place")


def mixed_candidates(spark, sf_dir):
    rows = comments(spark, sf_dir)
    nations = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("college"))
    groups = rows.where("l_returnflag = 'R' AND votes > 23").join(nations, "l_orderkey").groupBy("l_suppkey").agg(F.count_distinct("college").alias("n"))
    cross = groups.where("n >= 5")
    reported = rows.groupBy("l_suppkey").agg(F.bool_or((F.col("votes") == 25) & (F.col("l_linenumber") == 7)).alias("says")).where("says")
    apart = ratings.divergent(rows, "l_suppkey", "votes", 24)
    return ratings.strongest_reason([(cross, "cross", 3), (reported, "self", 2), (apart, "divergent", 1)], "l_suppkey")


def vote_extremes(spark, sf_dir):
    return ratings.extremes(comments(spark, sf_dir), "l_suppkey", "votes", TIE).select("l_suppkey", "side", "rank", "l_orderkey", "l_partkey", "votes")


def mention_owner(spark, sf_dir):
    """For each source the word, out of a list, that its documents mention most; of equal counts the longer word."""
    docs = load(spark, sf_dir, "documents").groupBy("source").agg(*[F.sum(entities.mentions(F.col("text"), F.lit(w))).alias(w) for w in MENTIONED])
    long = docs.select("source", F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.col(w).alias("n")) for w in MENTIONED])))
    return long.groupBy("source").agg(F.max_by(F.struct("word", "n"), F.struct("n", F.length("word"), "word")).alias("m")).select("source", "m.word", "m.n")


def comment_concat(spark, sf_dir):
    """All flags of a supplier's lines in the order of their places."""
    lines = load(spark, sf_dir, "lineitem").withColumn("said", F.when(F.col("l_quantity") > 10, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))))
    found = ratings.concatenated(lines, "l_suppkey", "said", ["l_orderkey", "l_linenumber", "l_partkey"], "/")
    return found.select("l_suppkey", F.length("said").alias("n"), F.md5("said").alias("digest"))


MENTIONED = ("tion", "ent", "eau", "heit", "ciones")


def longest_name_match(spark, sf_dir):
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    found = entities.longest_contained(docs, "doc_id", "text", items, "text")
    return found.select("doc_id", F.md5("name").alias("name_md5"), "length")


def questions(spark, sf_dir):
    """Made-up questions: the whole name of a part, its first letters with another ending, or a stray word."""
    name = F.col("p_name")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("who teaches "), name, F.lit(" best"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("which "), F.left(name, F.lit(4)), F.lit("xx is good"))).otherwise(F.lit("what is for lunch"))
    return load(spark, sf_dir, "part").select("p_partkey", text.alias("question"))


def prefix_course_match(spark, sf_dir):
    names = load(spark, sf_dir, "part").select("p_name").distinct()
    return entities.by_prefix(questions(spark, sf_dir), "p_partkey", "question", names, "p_name", keep=keeper(spark)).select("p_partkey", "course", "exact")


#: Slang of two courses, one of which is none of the parts.
COURSE_SLANG = {"sb": ["small bolt"], "rw": ["red widget", "gone"]}


def _judgements(spark, sf_dir):
    """A made-up question for each order: someone named in one of several ways, a part they supply or another, and an intent or none."""
    line = F.min(F.struct("l_suppkey", "l_partkey"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(line.alias("l")).select("id", "l.*")
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    names = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    kind = F.col("id") % 7
    who = F.when(kind == 1, F.lower("s_name")).when(kind == 2, F.concat(F.lit("q"), F.col("l_suppkey").cast("string"), F.lit("z"))).when(kind == 3, "someone").when(kind == 4, F.concat(F.lit("q"), F.col("l_suppkey").cast("string"), F.lit("z sb"))).otherwise(F.col("s_name"))
    what = F.when(kind == 5, F.concat(F.col("p_name"), F.lit(" or stainless hot washer"))).otherwise(F.col("p_name"))
    return lines.join(parts, "l_partkey").join(names, "l_suppkey").select("id", F.concat(F.when(kind == 6, "where is ").otherwise("how good is "), who, F.lit(" for "), what).alias("question"))


def _teaching(spark, sf_dir):
    people = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lower("s_name").alias("pinyin"), F.concat(F.lit("q"), F.col("s_suppkey").cast("string"), F.lit("z")).alias("initials"))
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    teaches = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(parts, "l_partkey").select(F.col("l_suppkey").alias("s_suppkey"), "p_name").distinct()
    return people, teaches


def course_detection(spark, sf_dir):
    asked = _judgements(spark, sf_dir)
    people, teaches = _teaching(spark, sf_dir)
    slang = entities.expand_slang(F.col("question"), COURSE_SLANG, ["small bolt", "red widget"])
    found = entities.detect(asked, "id", "question", dialogue.has_intent(F.col("question"), ["how good"]), people, "s_suppkey", "s_name", "pinyin", "initials", teaches, "p_name", slang, keeper(spark))
    return found.select("id", "name", "p_name", F.array_join("candidates", ",").alias("candidates"))


def courses_asked(spark, sf_dir):
    """The courses that a question names in full or by slang, else the one whose beginning it holds."""
    keep = keeper(spark)
    asked = keep(_judgements(spark, sf_dir))
    names = load(spark, sf_dir, "part").select("p_name").where("p_partkey % 3 > 0").distinct()
    slang = entities.expand_slang(F.col("question"), COURSE_SLANG, ["small bolt", "red widget"])
    return entities.by_prefix(asked, "id", "question", names, "p_name", slang=slang, keep=keep).select("id", "course", "exact")


def resolve_chain(spark, sf_dir):
    users = load(spark, sf_dir, "customer").select("c_custkey", "c_name", F.regexp_extract("c_name", r"(\d+)$", 1).alias("digits"))
    users = users.withColumn("tail", F.right("digits", F.lit(2)))
    names = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.regexp_replace("s_name", "Supplier", "Customer").alias("name"), "s_acctbal")
    exact = names.where("s_acctbal > 5000").select(F.col("name").alias("term"), "id")
    digits = names.where("s_acctbal > 2000").select(F.regexp_extract("name", r"(\d+)$", 1).alias("term"), "id")
    tails = names.where("s_acctbal > -500").select(F.right("name", F.lit(2)).alias("term"), "id")
    return entities.resolve(users, "c_custkey", [("name", "c_name", exact), ("digits", "digits", digits), ("tail", "tail", tails)])


def fuzzy_match(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    asked = parts.select("p_partkey", F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 100)).alias("asked"))
    return fuzzy.fuzzy_matches(asked, "p_partkey", "asked", parts, "p_name")


SLANG = {"th": ["Theory"], "tha": ["Thesis A", "Thesis B"], "on": ["Online"], "que": ["Queueing"], "ing": ["Engineering", "Gone"]}
COURSES = ["Theory", "Thesis A", "Thesis B", "Online", "Queueing", "Engineering"]


def slang_overlap(spark, sf_dir):
    talk = load(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", F.array_join(entities.expand_slang(F.lower("text"), SLANG, COURSES), ",").alias("courses"))


FORMAL = {"the": "definite article", "ing": "gerund", "que": "pronoun"}


def query_expansion(spark, sf_dir):
    talk = load(spark, sf_dir, "conversations").where("role = 'user'")
    return talk.select("conv_id", "turn", entities.expand_query(F.lower("text"), FORMAL).alias("expanded"))


def text_quality(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", ratings.comment_quality(F.col("text")).alias("quality"))


QUERIES = {
    f.__name__: f
    for f in (
        comment_weight, rating_card, rating_card_nested, course_candidates, mixed_candidates, vote_extremes, mention_owner, comment_concat, longest_name_match,
        prefix_course_match, course_detection, courses_asked, resolve_chain, fuzzy_match, slang_overlap, query_expansion, text_quality,
    )
}

_COMMENTS = """
comments AS (
  SELECT *, l_quantity - 25 AS votes,
    (CASE WHEN l_quantity > 25 THEN 1 + log2(l_quantity - 24) WHEN l_quantity < 25 THEN 1 - log2(26 - l_quantity) ELSE 1.0 END)
      * exp(-CAST(0.35 AS DOUBLE) * greatest(0.0, (1009843200 - CAST(epoch(l_shipdate) AS BIGINT)) / CAST(31557600.0 AS DOUBLE))) AS weight
  FROM lineitem)"""
_TIE = "l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate"
_TOP = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(weight, 9) DESC, {_TIE}) AS r FROM comments WHERE l_linestatus = 'O'),
top AS (
  SELECT *, l_returnflag AS cluster,
    CAST(row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY round(weight, 9) DESC, {_TIE}) AS INTEGER) AS rank
  FROM ranked WHERE r <= 60 QUALIFY rank <= 3)"""
_COUNTED = ", ".join(f"CAST(sum((length(text) - length(replace(text, '{w}', ''))) // {len(w)}) AS BIGINT) AS \"{w}\"" for w in MENTIONED)
_LONG = " UNION ALL ".join(f"SELECT source, '{w}' AS word, \"{w}\" AS n FROM counted" for w in MENTIONED)

_JUDGEMENTS = """
judged AS (
  SELECT l_orderkey AS id, CASE WHEN l_orderkey % 7 = 6 THEN 'where is ' ELSE 'how good is ' END
    || CASE l_orderkey % 7 WHEN 1 THEN lower(s_name) WHEN 2 THEN 'q' || l_suppkey || 'z' WHEN 3 THEN 'someone' WHEN 4 THEN 'q' || l_suppkey || 'z sb' ELSE s_name END
    || ' for ' || CASE l_orderkey % 7 WHEN 5 THEN p_name || ' or stainless hot washer' ELSE p_name END AS q
  FROM (SELECT l_orderkey, unnest(min({'l_suppkey': l_suppkey, 'l_partkey': l_partkey})) FROM lineitem GROUP BY l_orderkey) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
slang_courses AS (SELECT id, q, list_concat(CASE WHEN contains(q, 'sb') THEN ['small bolt'] ELSE [] END, CASE WHEN contains(q, 'rw') THEN ['red widget'] ELSE [] END) AS slang FROM judged)"""
ORACLES = {
    "comment_concat": """
WITH said AS (
  SELECT l_suppkey, coalesce(string_agg(l_returnflag || l_linenumber, '/' ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) FILTER (l_quantity > 10), '') AS said FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CAST(length(said) AS INTEGER) AS n, md5(said) AS digest FROM said""",
    "course_detection": f"""
WITH {_JUDGEMENTS},
asking AS (SELECT * FROM slang_courses WHERE contains(q, 'how good')),
named AS (SELECT id, s_name FROM asking JOIN supplier ON contains(q, s_name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(s_name) DESC, s_name) = 1),
hits AS (
  SELECT id, s_suppkey, 0 AS step FROM named JOIN supplier USING (s_name)
  UNION SELECT id, s_suppkey, 2 FROM asking JOIN supplier ON contains(lower(q), lower(s_name)) WHERE len(slang) = 0
  UNION SELECT id, s_suppkey, 3 FROM asking JOIN supplier ON contains(lower(q), 'q' || s_suppkey || 'z') WHERE len(slang) = 0),
found AS (SELECT * FROM hits QUALIFY step = min(step) OVER (PARTITION BY id)),
meant AS (SELECT id, arg_min(s_name, s_suppkey) AS name, array_to_string(list_sort(list(DISTINCT s_suppkey)), ',') AS candidates FROM found JOIN supplier USING (s_suppkey) GROUP BY id),
teaches AS (SELECT DISTINCT l_suppkey AS s_suppkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
held AS (SELECT id, p_name FROM asking JOIN (SELECT DISTINCT p_name FROM teaches) ON contains(q, p_name)),
own AS (SELECT DISTINCT id, p_name, true AS own FROM found JOIN teaches USING (s_suppkey)),
picked AS (SELECT id, p_name FROM held LEFT JOIN own USING (id, p_name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(own, false) DESC, length(p_name) DESC, p_name) = 1)
SELECT id, name, p_name, candidates FROM meant LEFT JOIN picked USING (id)""",
    "courses_asked": f"""
WITH {_JUDGEMENTS},
names AS (SELECT DISTINCT p_name AS course FROM part WHERE p_partkey % 3 > 0),
all_hits AS (
  SELECT id, course, contains(lower(q), lower(course)) AS exact FROM slang_courses JOIN names ON contains(lower(q), lower(course[1:4]))
  UNION ALL SELECT id, course, true FROM (SELECT id, unnest(slang) AS course FROM slang_courses) JOIN names USING (course)),
hits AS (SELECT id, course, bool_or(exact) AS exact FROM all_hits GROUP BY ALL),
ranked AS (
  SELECT *, count(*) FILTER (exact) OVER (PARTITION BY id) AS n_exact, count(*) OVER (PARTITION BY id) AS n_hits,
         row_number() OVER (PARTITION BY id ORDER BY length(course) DESC, course) AS rank FROM hits)
SELECT id, course, exact FROM ranked WHERE exact OR (n_exact = 0 AND n_hits <= 20 AND rank = 1)""",
    "comment_weight": f"""
WITH {_COMMENTS}
SELECT l_suppkey, count(*) AS n, round(sum(weight), 6) AS total_weight, round(max(weight), 6) AS top_weight FROM comments GROUP BY l_suppkey""",
    "rating_card": f"""
WITH {_COMMENTS}, {_TOP}
SELECT l_suppkey, cluster, rank, l_orderkey, l_partkey, round(weight, 6) AS weight FROM top""",
    "rating_card_nested": f"""
WITH {_COMMENTS}, {_TOP},
taught AS (SELECT l_suppkey, p_brand, count(*) AS n FROM comments JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' GROUP BY ALL),
courses AS (SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY CASE WHEN n >= 15 THEN 1 ELSE 0 END DESC, n DESC, p_brand) AS courses FROM taught GROUP BY l_suppkey),
per AS (SELECT l_suppkey, cluster, cluster || ':' || string_agg(l_orderkey || '-' || l_linenumber, '/' ORDER BY rank) AS ids FROM top GROUP BY l_suppkey, cluster),
clusters AS (SELECT l_suppkey, string_agg(ids, ';' ORDER BY cluster) AS clusters FROM per GROUP BY l_suppkey)
SELECT s_suppkey AS l_suppkey, s_name, courses, clusters FROM supplier LEFT JOIN courses ON courses.l_suppkey = s_suppkey LEFT JOIN clusters ON clusters.l_suppkey = s_suppkey""",
    "course_candidates": """
WITH teaches AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45')),
found AS (
  SELECT l_suppkey, s_name AS teacher, round(s_acctbal, 2) AS rating, CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS rating_count,
         string_agg(p_brand, ',' ORDER BY p_brand) AS courses, count(*) AS n
  FROM teaches JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT l_suppkey, teacher, rating, courses, CASE WHEN n > 1 THEN 'choose' ELSE 'card' END AS kind,
       CAST(row_number() OVER (ORDER BY rating_count > 0 DESC, rating DESC, rating_count DESC, l_suppkey) AS INTEGER) AS place
FROM found""",
    "mixed_candidates": """
WITH crossed AS (
  SELECT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity - 25 > 23
  GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 5),
said AS (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity = 50 AND l_linenumber = 7)),
apart AS (
  SELECT l_suppkey FROM lineitem GROUP BY 1
  HAVING count(*) >= 10 AND count(*) FILTER (l_quantity - 25 > 24) >= 2 AND count(*) FILTER (l_quantity - 25 < -24) >= 2),
reasons AS (SELECT l_suppkey, 'cross' AS reason, 3 AS p FROM crossed UNION ALL SELECT l_suppkey, 'self', 2 FROM said UNION ALL SELECT l_suppkey, 'divergent', 1 FROM apart)
SELECT l_suppkey, max_by(reason, p) AS reason FROM reasons GROUP BY l_suppkey""",
    "vote_extremes": f"""
WITH rows AS (SELECT *, l_quantity - 25 AS votes FROM lineitem),
up AS (SELECT *, 'positive' AS side, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, {_TIE}) AS rank FROM rows WHERE votes > 0),
down AS (SELECT *, 'negative' AS side, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes, {_TIE}) AS rank FROM rows WHERE votes < 0)
SELECT l_suppkey, side, CAST(rank AS INTEGER) AS rank, l_orderkey, l_partkey, votes FROM (SELECT * FROM up UNION ALL SELECT * FROM down) WHERE rank <= 2""",
    "mention_owner": f"""
WITH counted AS (SELECT source, {_COUNTED} FROM documents GROUP BY source),
long AS ({_LONG})
SELECT source, word, n FROM long QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, length(word) DESC, word DESC) = 1""",
    "longest_name_match": """
SELECT doc_id, md5(b.text) AS name_md5, CAST(length(b.text) AS INTEGER) AS length
FROM documents d JOIN benchmark b ON contains(d.text, b.text)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(b.text) DESC, b.text) = 1""",
    "prefix_course_match": r"""
WITH questions AS (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'who teaches ' || p_name || ' best' WHEN 1 THEN 'which ' || p_name[1:4] || 'xx is good' ELSE 'what is for lunch' END AS question
  FROM part),
names AS (SELECT DISTINCT p_name AS course FROM part WHERE p_name <> ''),
hits AS (
  SELECT p_partkey, course, contains(lower(question), lower(course)) AS exact
  FROM questions JOIN names ON contains(lower(question), lower(course)) OR (length(course) >= 4 AND contains(lower(question), lower(course[1:4])))),
ranked AS (
  SELECT *, count(*) FILTER (exact) OVER (PARTITION BY p_partkey) AS n_exact, count(*) OVER (PARTITION BY p_partkey) AS n_hits,
         row_number() OVER (PARTITION BY p_partkey ORDER BY length(course) DESC, course) AS rank
  FROM hits)
SELECT p_partkey, course, exact FROM ranked WHERE exact OR (n_exact = 0 AND n_hits <= 20 AND rank = 1)""",
    "resolve_chain": r"""
WITH names AS (SELECT s_suppkey AS id, replace(s_name, 'Supplier', 'Customer') AS name, s_acctbal FROM supplier),
exact AS (SELECT name AS term, min(id) AS id FROM names WHERE s_acctbal > 5000 GROUP BY 1),
digits AS (SELECT regexp_extract(name, '(\d+)$', 1) AS term, min(id) AS id FROM names WHERE s_acctbal > 2000 GROUP BY 1),
tails AS (SELECT right(name, 2) AS term, min(id) AS id FROM names WHERE s_acctbal > -500 GROUP BY 1)
SELECT c_custkey, coalesce(e.id, d.id, t.id) AS id,
       CASE WHEN e.id IS NOT NULL THEN 'name' WHEN d.id IS NOT NULL THEN 'digits' WHEN t.id IS NOT NULL THEN 'tail' ELSE 'none' END AS step
FROM customer LEFT JOIN exact e ON e.term = c_name LEFT JOIN digits d ON d.term = regexp_extract(c_name, '(\d+)$', 1)
LEFT JOIN tails t ON t.term = right(c_name, 2)""",
    # Terms of three letters overlap none of their own length here, and those of two letters neither.
    "slang_overlap": """
WITH talk AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
slang AS (SELECT * FROM (VALUES ('th', ['Theory']), ('tha', ['Thesis A', 'Thesis B']), ('on', ['Online']), ('que', ['Queueing']), ('ing', ['Engineering'])) s(term, names)),
cut AS (SELECT conv_id, turn, term, names, length(term) AS n, string_split(t, term) AS p FROM talk, slang),
spots AS (
  SELECT conv_id, turn, n, names, unnest(list_transform(p[1:len(p) - 1], lambda x, i: CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + (i - 1) * n AS BIGINT))) AS s FROM cut),
kept AS (
  SELECT * FROM spots a WHERE n = 3 OR NOT EXISTS (
    SELECT 1 FROM spots b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.n = 3 AND a.s < b.s + b.n AND a.s + a.n > b.s)),
said AS (SELECT conv_id, turn, array_to_string(flatten(list(names ORDER BY n DESC, s)), ',') AS courses FROM kept GROUP BY ALL)
SELECT conv_id, turn, coalesce(courses, '') AS courses FROM talk LEFT JOIN said USING (conv_id, turn)""",
    "query_expansion": """
WITH asked AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user'),
extra AS (
  SELECT *, list_filter([
    CASE WHEN contains(t, 'the') AND NOT contains(t, 'definite article') THEN 'definite article' END,
    CASE WHEN contains(t, 'ing') AND NOT contains(t, 'gerund') THEN 'gerund' END,
    CASE WHEN contains(t, 'que') AND NOT contains(t, 'pronoun') THEN 'pronoun' END], lambda x: x IS NOT NULL) AS x
  FROM asked)
SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN t || ' ' || array_to_string(x, ' ') ELSE t END AS expanded FROM extra""",
    "text_quality": r"""
WITH heads AS (SELECT doc_id, trim(text, ' ') AS t FROM documents),
cut AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, 'disgusting', ''), 'worthless', ''), 'pathetic', ''), 'stupid', ''),
    'clown', ''), 'idiot', ''), 'loser', ''), 'moron', ''), 'trash', ''), 'scum', '') AS rest
  FROM heads),
bare AS (SELECT *, regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g') AS bt, regexp_replace(rest, '[^\p{L}\p{N}]+', '', 'g') AS br FROM cut)
SELECT doc_id, CAST(CASE WHEN t = '' THEN 1 WHEN length(bt) < 2 THEN CASE WHEN bt IN ('好', '赞', '棒', '强', '差', '坑', '水', 'ok', 'gd') THEN 0 ELSE 1 END
  WHEN rest = t THEN 0 WHEN br = '' THEN 1
  WHEN regexp_matches(rest, 'teach|class|exam|homework|grade|course|good|bad|kind|strict') THEN 0
  WHEN length(br) < 8 THEN 1 ELSE 2 END AS INTEGER) AS quality
FROM bare""",
}
