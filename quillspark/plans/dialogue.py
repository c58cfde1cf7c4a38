"""Dialogue queries: conversations as questions, line items as comments, customers as users."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import batches, dialogue
from quillspark.sources.tables import load

INTENT = ["the", "que", "der"]


def question_intents(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", dialogue.has_intent(F.col("text"), INTENT).alias("intent"))


def card_decision(spark, sf_dir):
    """A question about an order: its suppliers of 45 or more pieces are the teachers, its parts of 40 or more the courses."""
    lines = load(spark, sf_dir, "lineitem")
    teachers = lines.where("l_quantity >= 48").select("l_orderkey", F.col("l_suppkey").alias("match"))
    courses = lines.where("l_quantity >= 40").select("l_orderkey", F.col("l_partkey").alias("match"))
    asked = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return dialogue.decide(asked, "l_orderkey", teachers, courses)


def candidate_narrowing(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    candidates = lines.where("l_linenumber = 1").select("l_orderkey", "l_suppkey").distinct()
    names = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("college"))
    asked = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 50 + 1).alias("asked_course"), F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 25).cast("string")).alias("asked_college"))
    teaches = lines.select("l_suppkey", F.col("l_partkey").alias("course"))
    rows = candidates.join(names, "l_suppkey").join(asked, "l_orderkey")
    return dialogue.narrowed(rows, "l_orderkey", teaches, "l_suppkey", None, None).select("l_orderkey", "l_suppkey")


def strong_mixed_signal(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return dialogue.strong_signal(docs, "source", F.col("lang"), F.col("text"), ["{} dos", "{}gg", "th{}"], r"\b(onst|enst|anst)\b")


def cluster_assignment(spark, sf_dir):
    lists = F.concat(F.lit('Sure: {"clusters": [['), F.col("doc_id").cast("string"), F.lit(","), (F.col("doc_id") + 1).cast("string"), F.lit("],["), F.col("doc_id").cast("string"), F.lit(",7]]}"))
    answer = F.when(F.col("doc_id") % 5 == 0, "no idea").when(F.col("doc_id") % 5 == 1, '{"clusters": [[1,').otherwise(lists)
    return dialogue.cluster_assignment(load(spark, sf_dir, "documents").select("doc_id", answer.alias("answer")), "doc_id", "answer")


def comment_review(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("comment"))
    answer = F.when(F.col("doc_id") % 4 == 0, '{"verdict": "junk"}').when(F.col("doc_id") % 4 == 1, 'x {"verdict": "sanitized", "text": " fine "} y').when(F.col("doc_id") % 4 == 2, '{"verdict": "sanitized"}')
    answers = load(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id", answer.alias("answer"))
    return dialogue.reviewed(docs, "doc_id", "comment", answers)


def context_numbering(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.left("text", F.lit(3)).alias("title"), "role", "text")
    asked = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 2).alias("conv_id")).union(load(spark, sf_dir, "conversations").select("conv_id")).distinct()
    return dialogue.contexts(turns, "conv_id", "turn", "title", "role", "text", asked)


def email_allowlist(spark, sf_dir):
    at = F.when(F.col("c_custkey") % 4 == 0, "@@").otherwise("@")
    domain = F.when(F.col("c_custkey") % 3 == 0, "UNI.edu ").when(F.col("c_custkey") % 3 == 1, "uni.edu.evil").otherwise("st.uni.edu")
    name = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", dialogue.allowed_email(F.concat(name, at, domain), ["uni.edu", "st.uni.edu"]).alias("allowed"))


def slang_edits(spark, sf_dir):
    """Brands as terms; orders of two priorities as edits, the greatest key last."""
    parts = load(spark, sf_dir, "part")
    terms = parts.groupBy(F.col("p_brand").alias("term")).agg(F.lit("course").alias("type"), F.array(F.min("p_name")).alias("names")).where("term < 'Brand#40'")
    orders = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    brand = F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 60).cast("string"))
    edits = orders.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 2 == 0, "set").otherwise("delete").alias("action"), brand.alias("term"), F.when(F.col("o_custkey") % 3 == 0, "rag").otherwise("course").alias("type"), F.array(F.concat(F.lit("name"), (F.col("o_custkey") % 4).cast("string")), F.lit("gone")).alias("names"))
    known = spark.createDataFrame([("name0",), ("name2",)], "name string")
    return dialogue.edited(terms, edits, known).select("term", "type", F.array_join("names", ",").alias("names"))


def review_batches(spark, sf_dir):
    """Documents by source in batches for a model, with what each holds."""
    made = batches.batches(load(spark, sf_dir, "documents"), "source", "doc_id", "text", 4000, 40, 150, 30_000)
    chars = F.aggregate("excerpts", F.lit(0), lambda a, x: a + F.length(x))
    return made.select("source", "part", "batch", F.size("ids").alias("n"), chars.alias("chars"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


QUERIES = {f.__name__: f for f in (review_batches, question_intents, card_decision, candidate_narrowing, strong_mixed_signal, cluster_assignment, comment_review, context_numbering, email_allowlist, slang_edits)}

ORACLES = {
    "question_intents": "SELECT conv_id, turn, contains(lower(text), 'the') OR contains(lower(text), 'que') OR contains(lower(text), 'der') AS intent FROM conversations",
    "card_decision": """
WITH t AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_quantity >= 48 GROUP BY 1),
c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS m FROM lineitem WHERE l_quantity >= 40 GROUP BY 1)
SELECT o_orderkey AS l_orderkey, CASE WHEN n = 1 THEN 'teacher' WHEN n > 1 THEN 'ambiguous' WHEN m = 1 THEN 'course' WHEN m > 1 THEN 'choose' ELSE 'none' END AS kind
FROM orders LEFT JOIN t ON t.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey""",
    "candidate_narrowing": """
WITH cand AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1),
fit AS (
  SELECT c.*, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = c.l_suppkey AND l.l_partkey = c.l_orderkey % 50 + 1) OR contains(n_name, 'NATION_' || (c.l_orderkey % 25)) AS ok
  FROM cand c JOIN supplier ON s_suppkey = c.l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = c.l_orderkey)
SELECT l_orderkey, l_suppkey FROM (SELECT *, bool_or(ok) OVER (PARTITION BY l_orderkey) AS anyone FROM fit) WHERE ok OR NOT anyone""",
    "strong_mixed_signal": r"""
WITH f AS (
  SELECT source, contains(text, lang || ' dos') OR contains(text, lang || 'gg') OR contains(text, 'th' || lang) AS says, regexp_extract_all(text, '\b(onst|enst|anst)\b', 1) AS cs FROM documents),
g AS (SELECT source, bool_or(says) AS says, len(list_distinct(flatten(list(cs)))) AS colleges FROM f GROUP BY source)
SELECT source, says, CAST(colleges AS BIGINT) AS colleges FROM g WHERE says OR colleges >= 2""",
    "cluster_assignment": """
WITH r AS (
  SELECT doc_id, unnest([(0, doc_id), (0, doc_id + 1), (1, doc_id), (1, 7)]) AS x FROM documents WHERE doc_id % 5 > 1)
SELECT doc_id, x[2] AS comment_id, CAST(min(x[1]) AS INTEGER) AS cluster FROM r GROUP BY doc_id, x[2]""",
    "comment_review": """
SELECT doc_id, text AS comment, CASE WHEN lang = 'de' THEN 'keep' WHEN doc_id % 4 = 0 THEN 'junk' WHEN doc_id % 4 = 1 THEN 'sanitized' ELSE 'keep' END AS verdict,
  CASE WHEN lang = 'de' THEN text WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'fine' ELSE text END AS shown
FROM documents""",
    "context_numbering": """
WITH h AS (SELECT conv_id, turn, text[1:3] AS title, role, text FROM conversations),
f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, title, role) AS first FROM h),
n AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM f),
m AS (SELECT conv_id, max(n) AS n_sources, string_agg('[' || n || '] ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM n GROUP BY conv_id),
asked AS (SELECT conv_id * 2 AS conv_id FROM conversations UNION SELECT conv_id FROM conversations)
SELECT conv_id, CAST(coalesce(n_sources, 0) AS INTEGER) AS n_sources, coalesce(context, 'No evidence was found.') AS context FROM asked LEFT JOIN m USING (conv_id)""",
    "email_allowlist": "SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 3 <> 1 AND c_custkey % 7 <> 0 AS allowed FROM customer",
    "slang_edits": """
WITH terms AS (SELECT p_brand AS term, 'course' AS type, min(p_name) AS names FROM part GROUP BY 1 HAVING p_brand < 'Brand#40'),
edits AS (
  SELECT o_orderkey AS seq, CASE WHEN o_custkey % 2 = 0 THEN 'set' ELSE 'delete' END AS action, 'Brand#' || (o_orderkey % 60) AS term,
    CASE WHEN o_custkey % 3 = 0 THEN 'rag' ELSE 'course' END AS type, 'name' || (o_custkey % 4) AS names FROM orders WHERE o_orderstatus = 'F'),
last AS (SELECT * FROM edits WHERE action = 'delete' OR names IN ('name0', 'name2') QUALIFY row_number() OVER (PARTITION BY term ORDER BY seq DESC) = 1)
SELECT coalesce(t.term, e.term) AS term, CASE WHEN e.action = 'set' THEN e.type ELSE t.type END AS type, CASE WHEN e.action = 'set' THEN e.names ELSE t.names END AS names
FROM terms t FULL JOIN last e ON t.term = e.term
WHERE NOT coalesce(e.action = 'delete' AND e.type = t.type, false) AND (coalesce(e.action = 'set', false) OR t.term IS NOT NULL)""",
}
ORACLES["review_batches"] = """
WITH cut AS (SELECT source, doc_id, text[1:150] AS x FROM documents),
sized AS (SELECT *, ceil(sum(greatest(length(x), 1)) OVER (PARTITION BY source) / 30000.0) AS parts FROM cut),
dealt AS (SELECT *, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % CAST(parts AS BIGINT) AS INTEGER) AS part FROM sized),
begun AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY source, part ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 3850 AS win FROM dealt),
turns AS (SELECT *, (row_number() OVER (PARTITION BY source, part, win ORDER BY doc_id) - 1) // 40 AS turn FROM begun),
made AS (SELECT source, part, win, turn, count(*) AS n, sum(length(x)) AS chars, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM turns GROUP BY ALL)
SELECT source, part, CAST(row_number() OVER (PARTITION BY source, part ORDER BY win, turn) AS INTEGER) AS batch, CAST(n AS INTEGER) AS n, CAST(chars AS INTEGER) AS chars, ids FROM made"""
