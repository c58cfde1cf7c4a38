"""Governance queries: `documents` with source as organisation and lang as category, `labels` as review flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import governance as gov
from quillspark.operators import intake
from quillspark.sources.sinks import counted_write, set_aside
from quillspark.sources.tables import load
from quillspark.streaming.usage import work_folder

ALLOWED = r"\x{20}-\x{7E}\n\x{2000}-\x{206F}"
HIGH, LOW = ["tion", "eau", "heit", "ment", "ción"], ["ble", "oui", "sch", "rr", "and"]
PEOPLE, STAFF, GATED = ["then", "lich", "pour"], ["worthless", "eux", "keit"], ["and", "rr"]


def titled(spark, sf_dir):
    """Documents with a title, the first line cut at 40 characters, and a made-up source link."""
    docs = load(spark, sf_dir, "documents")
    title = F.left(F.element_at(F.split("text", "\n"), 1), F.lit(40)).alias("title")
    host = F.when(F.col("doc_id") % 11 == 0, "example.org").when(F.col("doc_id") % 7 == 0, "github.com").otherwise("www.uni.edu")
    path = F.when(F.col("doc_id") % 5 == 0, "/").otherwise(F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")))
    return docs.select("*", title, F.concat(F.lit("https://"), host, path).alias("source_url"))


_TITLED = """
titled AS (
  SELECT *, string_split(text, chr(10))[1][1:40] AS title,
    'https://' || CASE WHEN doc_id % 11 = 0 THEN 'example.org' WHEN doc_id % 7 = 0 THEN 'github.com' ELSE 'www.uni.edu' END
      || CASE WHEN doc_id % 5 = 0 THEN '/' ELSE '/' || source || '/' || doc_id END AS source_url
  FROM documents)"""


def doc_ids(spark, sf_dir):
    return titled(spark, sf_dir).select("doc_id", gov.make_doc_id(F.col("title"), F.col("source_url")).alias("stable_id"), gov.content_hash(F.col("text"), "chunks=350").alias("content_hash"))


def exact_duplicate_groups(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("digest", gov.body_digest(F.col("text")))
    return gov.duplicate_groups(docs, F.col("digest"), "doc_id", [F.col("source") == "src0", F.length("source")])


def dedup_report(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 9 == 0, "# heading only").when(F.col("doc_id") % 13 == 0, "OCR pending").otherwise(F.col("text"))
    docs = docs.select("source", gov.body_kind(body).alias("kind"))
    return gov.pivot_report(docs, "source", "kind", ["ocr", "empty", "ok"])


def title_semi_join(spark, sf_dir):
    """Documents whose normalised beginning is that of a document of src0, with how many of those there are."""
    docs = titled(spark, sf_dir).withColumn("norm", gov.norm_title(F.col("title")))
    published = docs.where("source = 'src0'").groupBy("norm").agg(F.count("*").alias("n_published"))
    return docs.where("source <> 'src0'").join(published, "norm").select("doc_id", "n_published")


def metadata(spark, sf_dir):
    docs = titled(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    category = F.when(F.col("lang") == "en", "政策").when(F.col("lang") == "fr", "通知").when(F.col("lang") == "de", "FAQ").otherwise("misc")
    org = F.when(F.col("source") == "src1", "浙江大学").when(F.col("source") == "src2", "教务处").when(F.col("source") == "src3", "工学院").otherwise(F.col("source"))
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected")
    return docs.select(
        F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("doc_id"), "title", "source_url", org.alias("source_org"), category.alias("category"),
        F.array(F.col("lang")).alias("tags"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("authority_level"),
        F.when(F.col("quality") == 1, "2024-05-01").when(F.col("quality") == 0, "May 2024").alias("publish_date"), F.when(F.col("toxic") == 1, "false").alias("valid"), status.alias("review_status"),
        F.when(F.col("quality") == 1, "2024-06-01").alias("last_checked_at"), F.when(F.col("quality") == 1, "editor").alias("maintainer"),
        F.lit(None).cast("array<string>").alias("applies_to"), F.lit(None).cast("array<string>").alias("campuses"), F.array(org).alias("colleges"),
        F.concat(F.when(F.col("lang") == "en", "本科 玉泉 ").when(F.col("lang") == "de", "本科新生 研究生 海宁 ").otherwise(""), "text").alias("body"),
    )


_META = _TITLED + """,
meta AS (
  SELECT 'document-' || t.doc_id AS doc_id, title, source_url, quality, toxic, t.lang,
    CASE t.lang WHEN 'en' THEN '政策' WHEN 'fr' THEN '通知' WHEN 'de' THEN 'FAQ' ELSE 'misc' END AS category,
    CASE source WHEN 'src1' THEN '浙江大学' WHEN 'src2' THEN '教务处' WHEN 'src3' THEN '工学院' ELSE source END AS org
  FROM titled t LEFT JOIN labels USING (doc_id)),
typed AS (
  SELECT *, contains(source_url, 'example.') AS placeholder,
    CASE WHEN contains(source_url, 'example.') THEN 'unknown' WHEN contains(source_url, 'github.com') THEN 'student_guide'
      WHEN category = '政策' THEN 'official_policy' WHEN category = '通知' THEN 'official_notice' WHEN category = 'FAQ' THEN 'official_guide' ELSE 'unknown' END AS source_type
  FROM meta),
full_meta AS (
  SELECT *,
    CASE WHEN source_type = 'student_guide' THEN 'student' WHEN source_type = 'unknown' THEN 'unknown' WHEN org = '浙江大学' THEN 'university'
      WHEN org = '教务处' THEN 'department' WHEN org = '工学院' THEN 'college' ELSE 'department' END AS authority_level,
    coalesce(toxic, 0) <> 1 AND NOT placeholder AS valid,
    CASE WHEN placeholder THEN 'rejected' WHEN quality = 1 THEN 'verified' WHEN quality = 0 OR toxic = 1 THEN 'rejected' ELSE 'needs_review' END AS review_status
  FROM typed)"""


def metadata_inference(spark, sf_dir):
    found = gov.normalise_metadata(metadata(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "source_type", "authority_level", "publish_date", "valid", "review_status", "maintainer", joined("applies_to"), joined("campuses"), joined("colleges"))


def metadata_validation(spark, sf_dir):
    found = gov.normalise_metadata(metadata(spark, sf_dir))
    required = ["schema_version", "doc_id", "title", "source_url", "category", "valid", "review_status"]
    errors = gov.validation_errors(required, found.columns)
    warned = gov.validation_warnings(F.col("source_url"), F.col("source_type"), F.col("authority_level"))
    checked = found.select("doc_id", errors.alias("errors"), warned.alias("warnings"), "valid", "review_status")
    return checked.select("doc_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), gov.triage(F.col("errors"), F.col("valid"), F.col("review_status")).alias("action"))


def publish_gate(spark, sf_dir):
    found = gov.normalise_metadata(metadata(spark, sf_dir))
    strict, loose = gov.publishable(F.col("valid"), F.col("review_status")), gov.publishable(F.col("valid"), F.col("review_status"), True)
    return found.select("doc_id", strict.alias("strict"), loose.alias("with_unreviewed"))


def audit_counts(spark, sf_dir):
    found = gov.normalise_metadata(metadata(spark, sf_dir)).withColumn("publishable", gov.publishable(F.col("valid"), F.col("review_status")))
    return found.groupBy("source_type", "review_status").agg(F.count("*").alias("documents"), F.count_if("publishable").alias("publishable"), F.count_if(~F.col("publishable")).alias("blocked"))


def doc_states(spark, sf_dir):
    """What a run found, against files of which several have one id: the first path's body decides."""
    docs = load(spark, sf_dir, "documents")
    files = docs.where("source <> 'src0'").select("doc_id", F.concat("source", F.lit("/a.md")).alias("path"), "text")
    files = files.unionByName(docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("a"), F.right("source", F.lit(1)), F.lit("/b.md")).alias("path"), F.concat("text", F.lit(" (old)")).alias("text")))
    found = docs.select("doc_id", F.when(F.col("source") == "src2", F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")).alias("text"))
    return intake.body_states(found, files, "doc_id", "path", "text").select("doc_id", "old_path", "state")


def changed_documents(spark, sf_dir):
    """Documents that cleaning would change, and in which fields."""
    docs = load(spark, sf_dir, "documents")
    clean = docs.select("doc_id", F.trim(F.regexp_replace("text", "[ \t]+", " ")).alias("text"), F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), "source")
    return intake.changed_fields(docs, clean, "doc_id", ["lang", "text", "source"]).select("doc_id", "changed", F.array_join("fields", ",").alias("fields"))


def quarantine(spark, sf_dir):
    """Documents written in one pass: later copies of a text and short ones are set aside, and read back by place."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    first = docs.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first"))
    judged = docs.join(first, F.md5("text") == F.col("digest"))
    reason = F.when(F.col("doc_id") > F.col("first"), "_dedup").when(F.length("text") < 40, "_short")
    folder = work_folder(spark, "aside")
    set_aside(judged.select("doc_id", "source", "first", "text"), reason, folder)
    return spark.read.parquet(folder).groupBy("place", "source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def observed_audit(spark, sf_dir):
    """Totals of a publishing run: counted while the documents are written, without another pass."""
    found = gov.normalise_metadata(metadata(spark, sf_dir)).withColumn("publishable", gov.publishable(F.col("valid"), F.col("review_status")))
    counts = {"documents": F.count("*"), "publishable": F.count_if("publishable"), "verified": F.count_if(F.col("review_status") == "verified"), "sources": F.approx_count_distinct("source_type")}
    seen = counted_write(found, lambda df: df.write.parquet(work_folder(spark, "audit")), **counts)
    return spark.createDataFrame([tuple(seen[c] for c in counts)], ", ".join(f"{c} long" for c in counts))


def keyword_verdict(spark, sf_dir):
    docs = titled(spark, sf_dir)
    hay = F.concat_ws(" ", "title", "lang", F.left(gov.without_footer(F.col("text"), "^(The and|De )"), F.lit(500)))
    verdict = gov.keyword_verdict(hay, HIGH, LOW, PEOPLE, STAFF, GATED)
    reason = gov.hard_reject(F.col("title"), F.col("text"), PEOPLE, ["lorem ipsum"], {"tables": r"\|", "lists": "^(in|of)"})
    return docs.select("doc_id", F.coalesce(reason, F.lit("")).alias("reject_reason"), verdict.alias("v")).select("doc_id", "reject_reason", "v.*")


def org_statistics(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    org = gov.norm_org(F.concat(F.lit("Uni "), F.col("source")), "Uni ", {"src1": "src0", "src2": "src0"})
    return docs.groupBy("lang").agg(F.count_distinct(org).alias("orgs"), F.count("*").alias("documents"))


def charset_cleanup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", gov.clean_charset(F.col("text"), ALLOWED).alias("c"))
    kept = gov.unless_shrunk(F.col("text"), F.col("c.clean"), 0.95)
    return docs.select("doc_id", "c.deleted", F.md5("c.clean").alias("clean_md5"), F.md5(kept).alias("kept_md5"))


def review_hints(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    rules = docs.sparkSession.createDataFrame([(1, "src1", "tion", "near copy"), (2, "src1", "the", "check the term"), (3, "src2", "eau", "water"), (4, "src3", "a", "any")], "rule_no int, source string, needle string, hint string")
    return gov.first_matching_rule(docs, "doc_id", "source", "text", rules, "no hint")


QUERIES = {
    f.__name__: f
    for f in (
        doc_ids, exact_duplicate_groups, dedup_report, title_semi_join, metadata_inference, metadata_validation, publish_gate, audit_counts, observed_audit, doc_states, changed_documents, quarantine,
        keyword_verdict, org_statistics, charset_cleanup, review_hints,
    )
}


def _held(hay: str, words: list[str]) -> str:
    return f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({hay}, w)))"


_SPACE = r"[\s\x{3000}]+"
ORACLES = {
    "doc_ids": f"""
WITH {_TITLED}
SELECT doc_id, 'kb-' || sha256(trim(source_url, ' ') || chr(10) || trim(title, ' '))[1:16] AS stable_id, sha256(text || 'chunks=350') AS content_hash FROM titled""",
    "exact_duplicate_groups": rf"""
WITH d AS (SELECT doc_id, source, md5(regexp_replace(text, '{_SPACE}', '', 'g')) AS digest FROM documents)
SELECT digest, count(*) AS n, arg_min(doc_id, (source = 'src0', length(source), doc_id)) AS canonical, count(*) - 1 AS copies
FROM d GROUP BY digest HAVING count(*) > 1""",
    "dedup_report": """
WITH k AS (
  SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'empty' WHEN doc_id % 13 = 0 THEN 'ocr'
    WHEN array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND x[1] NOT IN ('#', '>')), '') = '' THEN 'empty' ELSE 'ok' END AS kind
  FROM documents)
SELECT source, count(*) AS total, CAST(count(*) FILTER (kind = 'ocr') AS BIGINT) AS ocr, CAST(count(*) FILTER (kind = 'empty') AS BIGINT) AS "empty", CAST(count(*) FILTER (kind = 'ok') AS BIGINT) AS ok
FROM k GROUP BY source""",
    "title_semi_join": rf"""
WITH {_TITLED},
n AS (SELECT *, regexp_replace(lower(title), '{_SPACE}', '', 'g') AS norm FROM titled),
p AS (SELECT norm, count(*) AS n_published FROM n WHERE source = 'src0' GROUP BY norm)
SELECT doc_id, n_published FROM n JOIN p USING (norm) WHERE source <> 'src0'""",
    "metadata_inference": f"""
WITH {_META}
SELECT doc_id, source_type, authority_level, CASE WHEN quality = 1 THEN '2024-05-01' ELSE 'unknown' END AS publish_date, valid, review_status,
  CASE WHEN quality = 1 THEN 'editor' ELSE 'unassigned' END AS maintainer,
  CASE lang WHEN 'en' THEN '本科生' WHEN 'de' THEN '本科新生,研究生' ELSE '未明确' END AS applies_to,
  CASE lang WHEN 'en' THEN '玉泉校区' WHEN 'de' THEN '海宁国际校区' ELSE '未明确' END AS campuses,
  CASE WHEN authority_level = 'college' AND quality IS NULL AND coalesce(toxic, 0) <> 1 THEN '未明确' ELSE org END AS colleges
FROM full_meta""",
    "metadata_validation": f"""
WITH {_META},
e AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN trim(title, ' ') = '' THEN 'title empty' END,
    CASE WHEN category = 'misc' THEN 'category not allowed' END,
    CASE WHEN review_status = 'rejected' AND valid THEN 'rejected but valid' END], lambda x: x IS NOT NULL), '; ') AS errors,
    CASE WHEN ends_with(source_url, '.org/') OR ends_with(source_url, '.com/') OR ends_with(source_url, '.edu/') THEN 'source_url is a site''s home' ELSE '' END AS warnings
  FROM full_meta)
SELECT doc_id, errors, warnings,
  CASE WHEN errors <> '' THEN 'error' WHEN NOT valid OR review_status = 'rejected' THEN 'invalid' WHEN review_status <> 'verified' THEN 'unverified' ELSE 'load' END AS action
FROM e""",
    "publish_gate": f"""
WITH {_META}
SELECT doc_id, valid AND review_status = 'verified' AS strict, valid AND review_status IN ('verified', 'needs_review') AS with_unreviewed FROM full_meta""",
    "audit_counts": f"""
WITH {_META}, p AS (SELECT *, valid AND review_status = 'verified' AS publishable FROM full_meta)
SELECT source_type, review_status, count(*) AS documents, CAST(count(*) FILTER (p.publishable) AS BIGINT) AS publishable, CAST(count(*) FILTER (NOT p.publishable) AS BIGINT) AS blocked
FROM p GROUP BY ALL""",
    "keyword_verdict": rf"""
WITH {_TITLED},
hay AS (
  SELECT doc_id, title, regexp_replace(lower(title), '{_SPACE}', '', 'g') AS norm, regexp_replace(text, '{_SPACE}', '', 'g') AS bare,
    title || ' ' || lang || ' ' || array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x, ' '), '^(The and|De )')), chr(10))[1:500] AS h
  FROM titled),
n AS (
  SELECT *, {_held("h", PEOPLE)} > 0 AS people, {_held("h", STAFF)} AS staff, {_held("h", HIGH)} AS hi,
    {_held("h", [w for w in LOW if w not in GATED])} AS lo, {_held("h", GATED)} AS lo_gated, {_held("(norm || bare[1:500])", PEOPLE)} > 0 AS speaks
  FROM hay),
c AS (
  SELECT *, staff > 0 AND NOT people AS staff_only, CASE WHEN staff > 0 AND NOT people THEN 0 ELSE hi END AS nh,
    CASE WHEN staff > 0 AND NOT people THEN staff ELSE lo + CASE WHEN people THEN 0 ELSE lo_gated END END AS nl
  FROM n)
SELECT doc_id, CASE WHEN contains(bare, 'lorem ipsum') OR length(bare) < 30 THEN 'empty' WHEN contains(norm, '|') AND NOT speaks THEN 'tables'
    WHEN regexp_matches(norm, '^(in|of)') AND NOT speaks THEN 'lists' ELSE '' END AS reject_reason,
  CASE WHEN staff_only OR nl > nh THEN 'low' WHEN nh > nl THEN 'valuable' ELSE 'uncertain' END AS verdict,
  CAST(nh AS INTEGER) AS n_high, CAST(nl AS INTEGER) AS n_low
FROM c""",
    "org_statistics": """
SELECT lang, count(DISTINCT CASE WHEN source IN ('src1', 'src2') THEN 'src0' ELSE source END) AS orgs, count(*) AS documents FROM documents GROUP BY lang""",
    "charset_cleanup": r"""
WITH c AS (SELECT doc_id, text, regexp_replace(text, '[^\x{20}-\x{7E}\n\x{2000}-\x{206F}]', '', 'g') AS clean FROM documents)
SELECT doc_id, CAST(length(text) - length(clean) AS INTEGER) AS deleted, md5(clean) AS clean_md5,
  md5(CASE WHEN length(clean) < length(text) * CAST(0.95 AS DOUBLE) THEN text ELSE clean END) AS kept_md5
FROM c""",
    "review_hints": """
SELECT doc_id, CASE WHEN source = 'src1' AND contains(text, 'tion') THEN 'near copy' WHEN source = 'src1' AND contains(text, 'the') THEN 'check the term'
  WHEN source = 'src2' AND contains(text, 'eau') THEN 'water' WHEN source = 'src3' AND contains(text, 'a') THEN 'any' ELSE 'no hint' END AS hint
FROM documents""",
}
ORACLES["observed_audit"] = f"""
WITH {_META}, p AS (SELECT *, valid AND review_status = 'verified' AS publishable FROM full_meta)
SELECT count(*) AS documents, CAST(count(*) FILTER (publishable) AS BIGINT) AS publishable, CAST(count(*) FILTER (review_status = 'verified') AS BIGINT) AS verified, count(DISTINCT source_type) AS sources FROM p"""
ORACLES["doc_states"] = """
WITH files AS (
  SELECT doc_id, source || '/a.md' AS path, text FROM documents WHERE source <> 'src0'
  UNION ALL SELECT doc_id, 'a' || right(source, 1) || '/b.md', text || ' (old)' FROM documents WHERE doc_id % 3 = 0),
old AS (SELECT doc_id, min(path) AS old_path, arg_min(text, path) AS old FROM files GROUP BY doc_id),
found AS (SELECT doc_id, CASE WHEN source = 'src2' THEN text || ' (edited)' ELSE text END AS text FROM documents)
SELECT doc_id, old_path, CASE WHEN old_path IS NULL THEN 'new' WHEN old IS NOT DISTINCT FROM text THEN 'same' ELSE 'updated' END AS state FROM found LEFT JOIN old USING (doc_id)"""
ORACLES["changed_documents"] = r"""
WITH c AS (SELECT doc_id, text IS DISTINCT FROM trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ') AS t, lang = 'fr' AS l FROM documents)
SELECT doc_id, coalesce(l, false) OR t AS changed, array_to_string(list_filter([CASE WHEN l THEN 'lang' END, CASE WHEN t THEN 'text' END], lambda x: x IS NOT NULL), ',') AS fields FROM c"""
ORACLES["quarantine"] = """
WITH j AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)
SELECT CASE WHEN doc_id > first THEN '_dedup' WHEN length(text) < 40 THEN '_short' ELSE 'kept' END AS place, source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM j GROUP BY ALL"""
