"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.backoff import score
from quillspark.llm.common import table
from quillspark.llm.interleaved import document_media
from quillspark.llm.langid import predict_languages
from quillspark.llm.merkle import tampered_manifest
from quillspark.llm.mixing import poisson_mix, source_counts, tempered_weights
from quillspark.llm.neighbours import nearest
from quillspark.llm.secrets import find_secrets
from quillspark.llm.sharding import shard
from quillspark.llm.simhash import simhash_components
from quillspark.llm.spelling import spelling_variants
from quillspark.llm.toxicity import score_toxicity
from quillspark.llm.urlrules import filter_urls
from quillspark.llm.winnow import contamination


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed values of the contract: verdict, and host with path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = source_counts(docs)
    return poisson_mix(docs, tempered_weights(counts), counts=counts)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(spark, sf_dir, "documents"))


def op12_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_vector_packing": op1_vector_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_winnowing": op4_winnowing,
    "op5_url_rules": op5_url_rules,
    "op6_secrets": op6_secrets,
    "op7_interleaved": op7_interleaved,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_language_id": op9_language_id,
    "op10_backoff_scores": op10_backoff_scores,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pruned_graph_neighbours": op12_pruned_graph_neighbours,
    "op13_spelling_variants": op13_spelling_variants,
}

#: A-Z lower-cased, then runs of a-z, 0-9 and non-ASCII characters.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

#: crc32 by its table: one row, of 256 entries. crc(bytes) is then a fold over a list of bytes.
_CRC = """
crc_steps AS (SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


ORACLES: dict[str, str] = {
    # Every window of every item against every window of every document.
    "op4_winnowing": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
spans AS (SELECT item_id, w, least(13, len(w)) AS span FROM items WHERE len(w) > 0),
item_at AS (SELECT item_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS i FROM spans),
wanted AS (SELECT DISTINCT item_id, span, array_to_string(w[i:i + span - 1], ' ') AS win FROM item_at),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_at AS (SELECT doc_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS i FROM docs, (SELECT DISTINCT span FROM spans) WHERE len(w) >= span),
hits AS (SELECT doc_id, item_id, i, d.span FROM (SELECT doc_id, span, i, array_to_string(w[i:i + span - 1], ' ') AS win FROM doc_at) d JOIN wanted USING (span, win)),
hit_words AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + span - 1)) AS spot FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op10_backoff_scores": r"""
WITH seqs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
pairs AS (
  SELECT doc_id, unnest(list_prepend('', w)) AS p, unnest(list_append(w, '')) AS w FROM seqs),
one AS (SELECT w, count(*) AS n FROM pairs GROUP BY w),
two AS (SELECT p, w, count(*) AS n FROM pairs GROUP BY p, w),
scored AS (
  SELECT doc_id, CASE WHEN two.n >= 2 THEN ln(CAST(two.n AS DOUBLE) / a.n) ELSE ln(CAST(0.4 AS DOUBLE) * b.n / (SELECT count(*) FROM pairs)) END AS s
  FROM pairs JOIN two ON two.p = pairs.p AND two.w = pairs.w JOIN one a ON a.w = pairs.p JOIN one b ON b.w = pairs.w)
SELECT doc_id, count(*) AS n_tokens, round(sum(s), 4) AS log_score, round(sum(s) / count(*), 6) AS mean_log_score FROM scored GROUP BY doc_id""",
    # Trees level by level as rows; every leaf is folded with its neighbours' strings.
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_CRC},
docs AS (
  SELECT *, text IS NOT NULL AND {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 2 = 0 AS touched FROM documents, crc_table),
leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS g, sha256({"||".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    sha256({"||".join(map(_field, ("doc_id", "source", "lang", "n_chars", "CASE WHEN touched THEN replace(text, chr(10), '') ELSE text END")))}) AS received FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT g, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 3, n),
subroots AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
every AS (SELECT g, level, pos, n, digest FROM nodes UNION ALL SELECT NULL, level, pos, n, digest FROM tops),
beside AS (
  SELECT a.g, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.g, a.level, a.pos),
lower_fold AS (
  SELECT g, pos AS leaf_at, 0 AS level, pos, received AS h, '' AS seen FROM placed
  UNION ALL
  SELECT f.g, leaf_at, f.level + 1, f.pos // 3, sha256(l || h || r), seen || l || r FROM lower_fold f JOIN beside b ON b.g = f.g AND b.level = f.level AND b.pos = f.pos),
upper_fold AS (
  SELECT f.g, leaf_at, 0 AS level, s.pos, h, seen FROM lower_fold f JOIN subroots s ON s.g = f.g JOIN nodes k ON k.g = f.g AND k.n = 1 AND k.level = f.level
  UNION ALL
  SELECT f.g, leaf_at, f.level + 1, f.pos // 3, sha256(l || h || r), seen || l || r FROM upper_fold f JOIN beside b ON b.g IS NULL AND b.level = f.level AND b.pos = f.pos)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(f.seen) AS proof_sha256, f.h AS folded_root, f.h = t.digest AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN tops t ON t.n = 1 JOIN upper_fold f ON f.g = p.g AND f.leaf_at = p.pos AND f.level = t.level""",
    # Near words by all forms of every word with one character left out.
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, times, {_crc("flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END))")} AS h FROM each, crc_table),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
without AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM spots),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM without a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM without a JOIN words w ON w.word = a.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) USING (word)""",
    # The inverse of the distribution function by its running sums, which are added in the order that the query adds them.
    "op8_poisson_mix": """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, CAST(sum(n) OVER () AS DOUBLE) * w / sum(w) OVER () / n AS rate FROM counts),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM terms WHERE k < ceil(rate * 2 + 12 * sqrt(rate) + 20)),
curves AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY source),
draws AS (
  SELECT d.*, list_filter(c.cdfs, lambda x: x <= CAST(('0x' || substr(md5('8:' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0) AS under
  FROM documents d JOIN curves c ON d.source = c.source),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, len(under))) AS INTEGER) AS copy FROM draws)
SELECT doc_id, text, lang, source, n_chars, copy, md5('8:' || doc_id || ':' || copy) AS mix_key FROM copies""",
}
