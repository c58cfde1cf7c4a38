"""Document governance: identity, duplicates, validation, inference, the publish gate and keyword verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V

SPACE = r"[\s　]+"


def make_doc_id(title: Column, url: Column) -> Column:
    return F.concat(F.lit("kb-"), F.left(F.sha2(F.concat_ws("\n", F.trim(url), F.trim(title)), 256), F.lit(16)))


def content_hash(text: Column, stamp: str) -> Column:
    """Digest of a text with the stamp of the settings it was chunked by, so that new settings change it."""
    return F.sha2(F.concat(text, F.lit(stamp)), 256)


def body_digest(text: Column) -> Column:
    return F.md5(F.regexp_replace(text, SPACE, ""))


def norm_title(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), SPACE, "")


def duplicate_groups(docs: DataFrame, digest: Column, key: str, priority: list[Column]) -> DataFrame:
    """(digest, n, canonical, copies) for digests of more than one row; the canonical row is first by priority, then key.

    Keys of copies are not gathered; an anti join with canonical names them, whatever the size of a group.
    """
    ranked = docs.select(digest.alias("digest"), F.struct(*priority, F.col(key).alias("_key")).alias("rank"))
    groups = ranked.groupBy("digest").agg(F.count("*").alias("n"), F.min("rank")["_key"].alias("canonical"))
    return groups.where("n > 1").withColumn("copies", F.col("n") - 1)


def body_kind(text: Column, placeholder: str = r"^\s*\(?(scan|ocr pending)") -> Column:
    """ocr, empty or ok by what is left of a text without headings and quotes."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith(">"))
    rest = F.array_join(kept, "")
    return F.when(F.lower(rest).rlike(placeholder), "ocr").when(rest == "", "empty").otherwise("ok")


def pivot_report(docs: DataFrame, group: str, kind: str, kinds: list[str]) -> DataFrame:
    return docs.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def is_placeholder_url(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return low.contains("example.") | low.contains(".example") | low.contains("xxx.")


def is_root_url(url: Column) -> Column:
    """A scheme and a host, no path but a slash, no query."""
    return F.coalesce(url, F.lit("")).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/?(#.*)?$")


def as_list(values: Column, default: list[str]) -> Column:
    """Trimmed, non-blank members; the default if there is no list or it is empty."""
    kept = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(*[F.lit(d) for d in default]).cast("array<string>"))


def infer_source_type(url: Column, org: Column, tags: Column, category: Column, by_category: dict[str, str]) -> Column:
    """Placeholder sources are unknown, community sources student guides, others go by category."""
    community = F.lower(url).contains("github.com") | tags.contains("非官方资料") | F.lower(org).contains("github")
    out = F.when(is_placeholder_url(url), "unknown").when(community, "student_guide")
    for name, kind in by_category.items():
        out = out.when(category == name, kind)
    return out.otherwise("unknown")


def infer_authority(org: Column, source_type: Column, university: str = V.UNIVERSITY, departments: list[str] = V.DEPARTMENTS, college_marks: tuple[str, ...] = ("学院", "学园"), college_end: str = "系") -> Column:
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: org.contains(w))
    return (
        F.when(source_type == "student_guide", "student").when(source_type.isin("third_party", "unknown"), "unknown").when(F.trim(org) == university, "university")
        .when(any_of(departments), "department").when(any_of(college_marks) | org.endswith(college_end), "college").otherwise("department")
    )


def infer_audience(text: Column, groups: list[tuple[str, str, str | None]], default: str = V.UNSPECIFIED) -> Column:
    """Names of groups (mark, name, narrower mark that is another's) whose mark is in the text."""
    found = [F.when(text.contains(mark) & (~text.contains(other) if other else F.lit(True)), name) for mark, name, other in groups]
    names = F.array_compact(F.array(*found))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


AUDIENCES = [("本科新生", "本科新生", None), ("本科", "本科生", "本科新生"), ("研究生", "研究生", None), ("港澳台", "港澳台学生", None)]


def infer_campuses(text: Column, campuses: list[str] = V.CAMPUSES, abroad: str = "海宁") -> Column:
    listed = F.filter(F.array(*[F.lit(c) for c in campuses]), lambda c: text.contains(c))
    named = F.transform(listed, lambda c: F.concat(c, F.when(c == abroad, "国际校区").otherwise("校区")))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(V.UNSPECIFIED)))


def normalise_metadata(docs: DataFrame, body: str = "body") -> DataFrame:
    """Schema 2 from partial metadata: what is there is kept, what is missing inferred, unknown facts left open.

    Columns: title, source_url, source_org, category, tags, source_type, authority_level, publish_date, valid
    (string), review_status, last_checked_at, maintainer, applies_to, campuses, colleges. A college taken for
    the audience by an earlier migration is taken back unless someone checked the document. A placeholder
    source is rejected whatever else it says. Columns that the schema does not know are kept.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    given = lambda c: F.nullif(text(c), F.lit(""))
    by_category = {"政策": "official_policy", "通知": "official_notice", "FAQ": "official_guide"}
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    out = docs.withColumn("source_type", F.coalesce(given("source_type"), infer_source_type(text("source_url"), text("source_org"), tags, text("category"), by_category)))
    out = out.withColumn("authority_level", F.coalesce(given("authority_level"), infer_authority(text("source_org"), F.col("source_type"))))
    valid = F.lower(F.coalesce(given("valid"), F.lit("true"))) == "true"
    placeholder = is_placeholder_url(text("source_url"))
    status = F.coalesce(given("review_status"), F.when(~valid, "rejected").otherwise("needs_review"))
    date = given("publish_date")
    hay = F.concat_ws(" ", text("title"), tags)
    colleges = as_list(F.col("colleges"), [V.UNSPECIFIED])
    migrated = (F.col("authority_level") == "college") & (status == "needs_review") & given("last_checked_at").isNull()
    migrated = migrated & (F.coalesce(given("maintainer"), F.lit("unassigned")) == "unassigned") & (colleges == F.array(text("source_org")))
    audience = infer_audience(F.concat_ws(" ", hay, F.left(text(body), F.lit(2000))), AUDIENCES)
    campuses = infer_campuses(F.concat_ws(" ", hay, F.left(text(body), F.lit(1000))))
    has = lambda c: F.size(as_list(F.col(c), [])) > 0
    return out.select(
        *[c for c in docs.columns if c not in NORMALISED],
        F.lit(V.SCHEMA_VERSION).alias("schema_version"),
        F.coalesce(given("doc_id"), make_doc_id(text("title"), text("source_url"))).alias("doc_id"),
        text("title").alias("title"), text("source_url").alias("source_url"), text("source_org").alias("source_org"), text("category").alias("category"),
        "source_type", "authority_level",
        F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date).otherwise("unknown").alias("publish_date"),
        as_list(F.col("tags"), []).alias("tags"), (valid & ~placeholder).alias("valid"),
        F.when(placeholder, "rejected").otherwise(status).alias("review_status"), given("last_checked_at").alias("last_checked_at"),
        F.coalesce(given("maintainer"), F.lit("unassigned")).alias("maintainer"),
        F.when(has("applies_to"), as_list(F.col("applies_to"), [])).otherwise(audience).alias("applies_to"),
        F.when(has("campuses"), as_list(F.col("campuses"), [])).otherwise(campuses).alias("campuses"),
        F.when(migrated, F.array(F.lit(V.UNSPECIFIED))).otherwise(colleges).alias("colleges"),
    )


NORMALISED = (
    "schema_version", "doc_id", "title", "source_url", "source_org", "category", "source_type", "authority_level", "publish_date", "tags", "valid",
    "review_status", "last_checked_at", "maintainer", "applies_to", "campuses", "colleges",
)


def _messages(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(says)) for broken, says in rules])).cast("array<string>")


def validation_errors(required: list[str], columns: list[str]) -> Column:
    """All rules that a document breaks, as an array of messages; missing fields are told before any other rule."""
    missing = [(F.col(c).isNull() if c in columns else F.lit(True), f"missing {c}") for c in required]
    absent = _messages(missing)
    has = set(columns)
    rules: list[tuple[Column, str]] = []

    def rule(column: str, broken: Column, says: str) -> None:
        if column in has:
            rules.append((broken, says))

    rule("schema_version", F.col("schema_version") != V.SCHEMA_VERSION, "schema_version differs") if "schema_version" in has else None
    rule("doc_id", ~F.col("doc_id").rlike(r"^[a-z0-9][a-z0-9_-]{7,63}$"), "doc_id malformed") if "doc_id" in has else None
    for c in V.REQUIRED_TEXT:
        rule(c, F.trim(c) == "", f"{c} empty")
    if "source_url" in has:
        rule("source_url", ~F.col("source_url").rlike(r"^https?://[^/?#]+"), "source_url not a full link")
        if "valid" in has:
            rule("valid", is_placeholder_url(F.col("source_url")) & F.col("valid"), "placeholder source is valid")
    for c, allowed in (("category", V.CATEGORIES), ("source_type", V.SOURCE_TYPES), ("authority_level", V.AUTHORITY_LEVELS), ("review_status", V.REVIEW_STATUSES)):
        rule(c, ~F.col(c).isin(allowed), f"{c} not allowed")
    if {"review_status", "valid"} <= has:
        rule("valid", (F.col("review_status") == "rejected") & F.col("valid"), "rejected but valid")
    if "publish_date" in has:
        rule("publish_date", ~F.col("publish_date").rlike(r"^(\d{4}-\d{2}-\d{2}|unknown)$"), "publish_date malformed")
    for c in V.OPTIONAL_DATES:
        rule(c, ~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") if c in has else F.lit(False), f"{c} malformed")
    for c in V.NON_EMPTY_LISTS:
        rule(c, F.size(c) == 0 if c in has else F.lit(False), f"{c} empty")
    if {"review_status", "last_checked_at"} <= has:
        rule("last_checked_at", (F.col("review_status") == "verified") & F.col("last_checked_at").isNull(), "verified but never checked")
    if {"review_status", "maintainer"} <= has:
        rule("maintainer", (F.col("review_status") == "verified") & (F.col("maintainer") == "unassigned"), "verified but no maintainer")
    return F.when(F.size(absent) > 0, absent).otherwise(_messages(rules))


def validation_warnings(url: Column, source_type: Column, authority: Column) -> Column:
    return _messages([(is_root_url(url), "source_url is a site's home"), ((source_type == "student_guide") & (authority != "student"), "student guide of other authority")])


def publishable(valid: Column, status: Column, with_unreviewed: bool = False) -> Column:
    fit = status == "verified"
    if with_unreviewed:
        fit = fit | (status == "needs_review")
    return F.coalesce(valid & fit, F.lit(False))


def triage(errors: Column, valid: Column, status: Column) -> Column:
    """What a load does with a document: error before invalid before unverified before load."""
    return F.when(F.size(errors) > 0, "error").when(~valid | (status == "rejected"), "invalid").when(status != "verified", "unverified").otherwise("load")


def require_no_errors(docs: DataFrame, errors: str) -> DataFrame:
    """docs; raises if any document has errors, so that one bad document stops a load before anything is written."""
    bad = docs.where(F.size(errors) > 0).select(errors).limit(5).collect()
    if bad:
        raise ValueError(f"documents with errors: {[r[0] for r in bad]}")
    return docs


def without_footer(text: Column, footer: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(footer)), "\n")


def hard_reject(title: Column, body: Column, people: list[str], placeholders: list[str], title_rules: dict[str, str], min_chars: int = 30) -> Column:
    """Reason of a rejection or null: placeholder or short bodies; titles of a rule that speak of none of the people."""
    bare = F.regexp_replace(F.coalesce(body, F.lit("")), SPACE, "")
    hay = F.concat(norm_title(title), F.left(bare, F.lit(500)))
    speaks = F.exists(F.array(*[F.lit(p) for p in people]), lambda p: hay.contains(p))
    out = F.when(F.exists(F.array(*[F.lit(p) for p in placeholders]), lambda p: bare.contains(p)) | (F.length(bare) < min_chars), "empty")
    for reason, pattern in title_rules.items():
        out = out.when(norm_title(title).rlike(pattern) & ~speaks, reason)
    return out


def keyword_verdict(hay: Column, high: list[str], low: list[str], people: list[str], staff: list[str], gated: list[str]) -> Column:
    """struct<verdict, n_high, n_low>: more high words are valuable, more low words low, as many uncertain.

    Staff words without people's words are low at once. Gated low words count only where no people are spoken of.
    """
    held = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: hay.contains(w))
    people_there = F.size(held(people)) > 0
    staff_only = (F.size(held(staff)) > 0) & ~people_there
    n_high = F.size(held(high))
    n_low = F.size(held([w for w in low if w not in gated])) + F.when(people_there, 0).otherwise(F.size(held([w for w in low if w in gated])))
    n_high, n_low = F.when(staff_only, 0).otherwise(n_high), F.when(staff_only, F.size(held(staff))).otherwise(n_low)
    verdict = F.when(staff_only | (n_low > n_high), "low").when(n_high > n_low, "valuable").otherwise("uncertain")
    return F.struct(verdict.alias("verdict"), n_high.cast("int").alias("n_high"), n_low.cast("int").alias("n_low"))


def norm_org(org: Column, drop: str, renames: dict[str, str]) -> Column:
    out = F.trim(F.replace(org, F.lit(drop), F.lit("")))
    for old, new in renames.items():
        out = F.when(out == old, new).otherwise(out)
    return out


def clean_charset(text: Column, allowed: str) -> Column:
    """struct<clean, deleted>: the text without characters outside a character class, and how many went."""
    clean = F.regexp_replace(text, f"[^{allowed}]", "")
    return F.struct(clean.alias("clean"), (F.length(text) - F.length(clean)).cast("int").alias("deleted"))


def unless_shrunk(old: Column, new: Column, least: float = 0.8) -> Column:
    """new, but old if new is shorter than a share `least` of it."""
    return F.when(F.length(new) < F.length(old) * F.lit(least), old).otherwise(new)


def first_matching_rule(docs: DataFrame, key: str, source: str, text: str, rules: DataFrame, default: str) -> DataFrame:
    """(key, hint) by the first rule (rule_no, source, needle, hint) of a document's source whose needle it holds."""
    side = rules.select("rule_no", F.col("source").alias("_source"), "needle", "hint")
    joined = docs.join(side, (F.col(source) == F.col("_source")) & F.col(text).contains(F.col("needle")), "left")
    return joined.groupBy(key).agg(F.coalesce(F.min_by("hint", "rule_no"), F.lit(default)).alias("hint"))
