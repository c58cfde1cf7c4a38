"""Chunking, conversation and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import chunking, text
from quillspark.sources.tables import load


def marked(spark, sf_dir):
    """Documents as Markdown: every fifth line, counted from 0, is a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("md"))


def heading_split(spark, sf_dir):
    rows = marked(spark, sf_dir).select("doc_id", F.posexplode(chunking.heading_parts(F.col("md"))).alias("n", "part"))
    return rows.select("doc_id", "n", F.length("part").alias("chars"), F.md5("part").alias("part_md5"), F.length(chunking.carried_heading(F.col("part"))).alias("heading_chars"))


def paragraph_pack(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    packed = docs.select("doc_id", F.posexplode(chunking.pack(chunking.paragraphs(F.col("body")), 350)).alias("n", "chunk"))
    return packed.select("doc_id", "n", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


def chunk_records(spark, sf_dir):
    docs = marked(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return chunking.chunk_records(docs, "doc_id", "md", "source", "lang", F.array("lang", "source"), ["doc_id"]).select("id", "n", "doc_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def talk(spark, sf_dir):
    """Conversations with made-up citation marks, by turn."""
    mark = F.concat(F.lit(" ["), ((F.col("turn") * 7 + F.col("conv_id")) % 6).cast("string"), F.lit("] see [2025] and ["), (F.col("turn") + 1).cast("string"), F.lit("]"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("text", mark).alias("text"))


def citations_strip(spark, sf_dir):
    return talk(spark, sf_dir).select("conv_id", "turn", text.strip_citations(F.col("text")).alias("text"))


def citations_renumber(spark, sf_dir):
    r = text.renumber_citations(F.col("text"), (F.col("conv_id") % 5).cast("int"))
    return talk(spark, sf_dir).select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.text", F.array_join("r.cited", ",").alias("cited"))


def history_tail(spark, sf_dir):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = talk(spark, sf_dir).withColumn("back", F.row_number().over(last)).where("back <= 4")
    return rows.select("conv_id", "turn", "role", "back", F.left("text", F.lit(120)).alias("head"))


def turn_points(spark, sf_dir):
    points = talk(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", text.turn_summary(F.col("text")).alias("p"))
    return points.select("conv_id", "turn", F.array_join("p", "|").alias("points"))


def source_dedup(spark, sf_dir):
    """One row for each beginning and source: the smallest doc_id, with a snippet."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text", F.left("text", F.lit(60)).alias("title"))
    first = Window.partitionBy("title", "source").orderBy("doc_id")
    kept = docs.withColumn("r", F.row_number().over(first)).where("r = 1")
    return kept.select("doc_id", "source", text.snippet(F.col("text")).alias("snippet"))


def abbreviation_mining(spark, sf_dir):
    """Short words by how many documents have them, with guessed names (parts that hold the word)."""
    docs = load(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(text.tokens(F.lower("text")))).alias("w")).where("length(w) BETWEEN 2 AND 4 AND w RLIKE '^[a-z]+$' AND NOT w RLIKE '^[aeiouy]*$'")
    stop = ["the", "and", "for", "of", "to", "in"]
    counts = words.where(~F.col("w").isin(stop)).groupBy("w").agg(F.count("*").alias("n"), F.min("doc_id").alias("evidence")).where("n >= 5")
    top = counts.orderBy(F.desc("n"), "w").limit(60)
    names = load(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    guess = top.join(names, F.col("name").contains(F.col("w")), "left").groupBy("w", "n", "evidence").agg(F.slice(F.array_sort(F.collect_list("name")), 1, 2).alias("g"))
    return guess.select("w", "n", "evidence", F.array_join("g", ",").alias("guesses"))


QUERIES = {
    f.__name__: f
    for f in (heading_split, paragraph_pack, chunk_records, citations_strip, citations_renumber, history_tail, turn_points, source_dedup, abbreviation_mining)
}

_TALK = "talk AS (SELECT conv_id, turn, role, text || ' [' || ((turn * 7 + conv_id) % 6) || '] see [2025] and [' || (turn + 1) || ']' AS text FROM conversations)"
_NL = "chr(10)"
_SECTIONS = rf"""
m AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, {_NL}), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '## ' || x ELSE x END), {_NL}) AS md FROM documents),
lines AS (SELECT doc_id, unnest(string_split(md, {_NL})) AS line, generate_subscripts(string_split(md, {_NL}), 1) AS i FROM m),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{2,3}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM lines),
parts AS (SELECT doc_id, s, regexp_replace(string_agg(line, {_NL} ORDER BY i), '^\s+|\s+$', '', 'g') AS part FROM numbered GROUP BY doc_id, s),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS n FROM parts WHERE part <> '')"""
ORACLES = {
    # Long paragraphs line by line; the documents have no tables, whose heads later pieces would repeat.
    "chunk_records": rf"""
WITH RECURSIVE {_SECTIONS.strip()},
h AS (
  SELECT doc_id, n AS sec, part, CASE WHEN part[1] = '#' AND length(string_split(part, {_NL})[1]) <= 80 AND regexp_matches(part[length(string_split(part, {_NL})[1]) + 2:], '\S')
    THEN string_split(part, {_NL})[1] ELSE '' END AS heading FROM kept),
big AS (SELECT doc_id, sec, heading, greatest(120, 347 - length(heading)) AS room, CASE WHEN heading = '' THEN part ELSE part[length(heading) + 2:] END AS body FROM h WHERE length(part) > 350),
split AS (SELECT *, list_filter(string_split(body, {_NL} || {_NL}), lambda x: regexp_matches(x, '\S')) AS ps FROM big),
para AS (SELECT doc_id, sec, heading, room, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM split),
ln AS (SELECT doc_id, sec, pi, room, unnest(string_split(p, {_NL})) AS line, generate_subscripts(string_split(p, {_NL}), 1) AS li FROM para WHERE length(p) > room),
said AS (SELECT doc_id, sec, pi, li, room, regexp_extract_all(line, '[^。！？；!?]*[。！？；!?]|[^。！？；!?]+') AS ss FROM ln WHERE length(line) > room),
filled AS (
  SELECT *, 1 AS i, ss[1] AS buf, CAST([] AS VARCHAR[]) AS outs FROM said
  UNION ALL
  SELECT doc_id, sec, pi, li, room, ss, i + 1, CASE WHEN length(buf) + length(ss[i + 1]) > room THEN ss[i + 1] ELSE buf || ss[i + 1] END,
    CASE WHEN length(buf) + length(ss[i + 1]) > room THEN list_append(outs, buf) ELSE outs END
  FROM filled WHERE i < len(ss)),
cut AS (
  SELECT doc_id, sec, pi, li, flatten(list_transform(list_append(outs, buf), lambda b: list_transform(generate_series(0, (length(b) - 1) // room), lambda k: b[k * room + 1:(k + 1) * room]))) AS atoms
  FROM filled WHERE i = len(ss)),
atoms AS (SELECT doc_id, sec, pi, any_value(room) AS room, flatten(list(coalesce(atoms, [line]) ORDER BY li)) AS a FROM ln LEFT JOIN cut USING (doc_id, sec, pi, li) GROUP BY ALL),
divided AS (
  SELECT *, 1 AS i, [a[1]] AS held, CAST([] AS VARCHAR[]) AS pieces FROM atoms
  UNION ALL
  SELECT doc_id, sec, pi, room, a, i + 1, list_append(CASE WHEN over THEN again ELSE held END, a[i + 1]), CASE WHEN over THEN list_append(pieces, array_to_string(held, {_NL})) ELSE pieces END
  FROM (
    SELECT *, length(array_to_string(held, {_NL})) + 1 + length(a[i + 1]) > room AS over,
      CASE WHEN len(held) > 1 AND length(held[-1]) + length(held[-2]) <= 80 THEN held[-2:] WHEN length(held[-1]) <= 80 THEN held[-1:] ELSE CAST([] AS VARCHAR[]) END AS again
    FROM divided WHERE i < len(a))),
ready AS (SELECT doc_id, sec, pi, list_append(pieces, array_to_string(held, {_NL})) AS ps FROM divided WHERE i = len(a)),
todo AS (SELECT doc_id, sec, any_value(heading) AS heading, any_value(room) AS room, flatten(list(coalesce(ps, [p]) ORDER BY pi)) AS ps FROM para LEFT JOIN ready USING (doc_id, sec, pi) GROUP BY ALL),
fold AS (
  SELECT *, 1 AS i, ps[1] || {_NL} || {_NL} AS buf, CAST([] AS VARCHAR[]) AS outs FROM todo
  UNION ALL
  SELECT doc_id, sec, heading, room, ps, i + 1, CASE WHEN length(buf) + length(ps[i + 1]) > room THEN ps[i + 1] || {_NL} || {_NL} ELSE buf || ps[i + 1] || {_NL} || {_NL} END,
    CASE WHEN length(buf) + length(ps[i + 1]) > room THEN list_append(outs, regexp_replace(buf, '^\s+|\s+$', '', 'g')) ELSE outs END
  FROM fold WHERE i < len(ps)),
packed AS (SELECT doc_id, sec, heading, CASE WHEN regexp_matches(buf, '\S') THEN list_append(outs, regexp_replace(buf, '^\s+|\s+$', '', 'g')) ELSE outs END AS cs FROM fold WHERE i = len(ps)),
chunks AS (
  SELECT doc_id, sec, unnest(cs) AS c, generate_subscripts(cs, 1) AS k, heading FROM packed
  UNION ALL SELECT doc_id, sec, part, 1, NULL FROM h WHERE length(part) <= 350),
named AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) - 1 AS n,
    CASE WHEN coalesce(heading, '') = '' THEN c ELSE heading || CASE WHEN k > 1 THEN '（续）' ELSE '' END || {_NL} || c END AS c FROM chunks),
texts AS (
  SELECT doc_id, n, '标题：' || source || {_NL} || '分类：' || lang || {_NL} || '检索标签：' || lang || '、' || source || {_NL} || {_NL} || c AS t FROM named JOIN documents USING (doc_id))
SELECT doc_id || '::' || n AS id, CAST(n AS INTEGER) AS n, doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS text_md5 FROM texts""",
    "heading_split": rf"""
WITH {_SECTIONS.strip()},
h AS (SELECT *, string_split(part, {_NL})[1] AS head FROM kept)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(length(part) AS INTEGER) AS chars, md5(part) AS part_md5,
  CAST(CASE WHEN head[1] = '#' AND length(head) <= 80 AND trim(part[length(head) + 2:], ' ') <> '' THEN length(head) ELSE 0 END AS INTEGER) AS heading_chars
FROM h""",
    "paragraph_pack": rf"""
WITH RECURSIVE p AS (
  SELECT doc_id, list_filter(string_split(text, {_NL}), lambda x: trim(x, ' ') <> '') AS ps FROM documents),
fold AS (
  SELECT doc_id, ps, 1 AS i, ps[1] || {_NL} || {_NL} AS buf, CAST([] AS VARCHAR[]) AS outs FROM p WHERE len(ps) > 0
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN length(buf) + length(ps[i + 1]) > 350 THEN ps[i + 1] || {_NL} || {_NL} ELSE buf || ps[i + 1] || {_NL} || {_NL} END,
    CASE WHEN length(buf) + length(ps[i + 1]) > 350 THEN list_append(outs, regexp_replace(buf, '^\s+|\s+$', '', 'g')) ELSE outs END
  FROM fold WHERE i < len(ps)),
done AS (SELECT doc_id, list_append(outs, regexp_replace(buf, '^\s+|\s+$', '', 'g')) AS chunks FROM fold WHERE i = len(ps)),
rows AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS n FROM done)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(length(chunk) AS INTEGER) AS chars, md5(chunk) AS chunk_md5 FROM rows""",
    "citations_strip": rf"WITH {_TALK} SELECT conv_id, turn, regexp_replace(text, '\[[0-9]{{1,3}}\]', '', 'g') AS text FROM talk",
    "citations_renumber": rf"""
WITH {_TALK},
cut AS (
  SELECT conv_id, turn, text, conv_id % 5 AS n, regexp_split_to_array(text, '\[[0-9]{{1,4}}\]') AS gaps, regexp_extract_all(text, '\[[0-9]{{1,4}}\]') AS marks,
    list_transform(regexp_extract_all(text, '\[([0-9]{{1,4}})\]', 1), lambda x: CAST(x AS INTEGER)) AS said FROM talk),
valid AS (SELECT *, list_filter(said, lambda x: x BETWEEN 1 AND n) AS ok FROM cut),
used AS (SELECT *, list_filter(ok, lambda x, i: list_position(ok, x) = i) AS cited FROM valid)
SELECT conv_id, turn, CASE WHEN n = 0 THEN regexp_replace(text, '\[[0-9]{{1,3}}\]', '', 'g') ELSE array_to_string(list_transform(gaps, lambda g, i:
    g || CASE WHEN i > len(marks) THEN '' WHEN list_contains(cited, said[i]) THEN '[' || list_position(cited, said[i]) || ']' ELSE marks[i] END), '') END AS text,
  CASE WHEN n = 0 THEN '' ELSE array_to_string(cited, ',') END AS cited FROM used""",
    "turn_points": rf"""
WITH {_TALK},
clean AS (SELECT conv_id, turn, regexp_replace(text, '\[[0-9]{{1,4}}\]', '', 'g') AS c FROM talk WHERE role = 'assistant'),
kept AS (SELECT *, list_filter(list_transform(regexp_extract_all(c, '[^。！？!?]*[。！？!?]|[^。！？!?]+')[1:2], lambda s: trim(s, ' ')[1:40]), lambda s: s <> '') AS p FROM clean)
SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN array_to_string(p, '|') ELSE c[1:40] END AS points FROM kept""",
    "history_tail": f"""
WITH {_TALK}
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back, text[1:120] AS head FROM talk QUALIFY back <= 4""",
    "source_dedup": r"""
WITH k AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text[1:60], source ORDER BY doc_id) = 1),
b AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(text, '[#>|*`]+', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS body FROM k)
SELECT doc_id, source, CASE WHEN length(body) > 40 THEN body[1:40] || '…' ELSE body END AS snippet FROM b""",
    "abbreviation_mining": r"""
WITH words AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'))) AS w FROM documents),
counts AS (
  SELECT w, count(*) AS n, min(doc_id) AS evidence FROM words
  WHERE length(w) BETWEEN 2 AND 4 AND regexp_full_match(w, '[a-z]+') AND NOT regexp_full_match(w, '[aeiouy]*') AND w NOT IN ('the', 'and', 'for', 'of', 'to', 'in')
  GROUP BY w HAVING count(*) >= 5 ORDER BY n DESC, w LIMIT 60),
names AS (SELECT DISTINCT lower(p_name) AS name FROM part),
g AS (SELECT w, n, evidence, list(name ORDER BY name) FILTER (name IS NOT NULL) AS names FROM counts LEFT JOIN names ON contains(name, w) GROUP BY ALL)
SELECT w, n, evidence, coalesce(array_to_string(names[1:2], ','), '') AS guesses FROM g""",
}
