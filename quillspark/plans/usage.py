"""Usage queries: `events` as the activity log, error events as uncovered questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import usage
from quillspark.sources.tables import load
from quillspark.streaming import attempts
from quillspark.streaming import usage as streams

UNCOVERED = "event_type = 'error'"
NOW = "2024-01-30 12:00:00"


def usage_daily_counts(spark, sf_dir):
    return usage.daily_counts(load(spark, sf_dir, "events"), F.expr(UNCOVERED))


def usage_summary(spark, sf_dir):
    return usage.summary(load(spark, sf_dir, "events"), F.expr(UNCOVERED))


def usage_rolling_range(spark, sf_dir):
    return usage.daily_counts(usage.within_days(load(spark, sf_dir, "events"), NOW, 7), F.expr(UNCOVERED))


def uncovered_latest(spark, sf_dir):
    log = load(spark, sf_dir, "events")
    return usage.latest(log, F.expr(UNCOVERED), 100, [F.desc("ts"), F.desc("event_id")]).select("event_id", "ts", "user_id", "value")


def uncovered_with_user(spark, sf_dir):
    log = load(spark, sf_dir, "events").where(UNCOVERED)
    users = load(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name")
    return usage.with_user_names(log, users, "user_id", "c_custkey", "c_name").select("event_id", "user_id", "user_name")


def usage_page(spark, sf_dir):
    return usage.page(load(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 3, 50).select("event_id", "ts", "event_type")


def feedback_fold(spark, sf_dir):
    """Clicks set feedback to 1, errors to 0, purchases resolve; the latest event of each kind decides."""
    flags = {
        "feedback": F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 0 END"),
        "resolved": F.expr("CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END"),
    }
    return usage.fold_flags(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], flags)


def open_questions(spark, sf_dir):
    log = load(spark, sf_dir, "events").select("event_id", F.expr(f"CAST(NOT ({UNCOVERED}) AS INT)").alias("covered"), F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END").alias("feedback"))
    return log.where(usage.is_uncovered("covered", "feedback"))


def _second(ts):
    """The nearest second of a time, halves to the even one, as SQL casts epoch(ts)."""
    return F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("long")


def _attempts(spark, sf_dir):
    """Errors are failed and purchases successful attempts."""
    log = load(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    return log.select("user_id", "event_id", _second("ts").alias("at"), F.expr("event_type = 'purchase'").alias("ok"))


def _codes(spark, sf_dir):
    """Signups ask for a code of their value's last digit, errors and purchases try theirs."""
    events = load(spark, sf_dir, "events").where("event_type IN ('signup', 'error', 'purchase')")
    digit = F.expr("CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING)")
    return events.select("user_id", "event_id", _second("ts").alias("at"), F.expr("event_type = 'signup'").alias("asks"), digit.alias("code"))


#: Three failures lock a user for an hour. Six hours between codes, which live two days and bear two wrong tries.
LOCKS = {"max_failures": 3, "lock_seconds": 3600}
CODES = {"resend_seconds": 6 * 3600, "live_seconds": 48 * 3600, "max_tries": 2}


def lockout_fold(spark, sf_dir):
    return usage.lockouts(_attempts(spark, sf_dir), "user_id", **LOCKS)


def code_lifetimes(spark, sf_dir):
    return usage.code_outcomes(_codes(spark, sf_dir), "user_id", **CODES)


def stream_lockouts(spark, sf_dir):
    return attempts.outcomes_of_slices(_attempts(spark, sf_dir), "user_id", usage.lockout_fold(**LOCKS), streams.work_folder(spark, "locks"))


def stream_code_lifetimes(spark, sf_dir):
    return attempts.outcomes_of_slices(_codes(spark, sf_dir), "user_id", usage.code_fold(**CODES), streams.work_folder(spark, "codes"))


def gap_sessions(spark, sf_dir):
    log = load(spark, sf_dir, "events").withColumn("at", _second("ts"))
    numbered = usage.gap_sessions(log, "user_id", "at", 6 * 3600, "event_id")
    return numbered.groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def stream_daily_counts(spark, sf_dir):
    return streams.daily_counts_of_files(spark, sf_dir, "events", UNCOVERED)


def safe_parsing(spark, sf_dir):
    return usage.parsed_fields(load(spark, sf_dir, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        usage_daily_counts, usage_summary, usage_rolling_range, uncovered_latest, uncovered_with_user, usage_page, feedback_fold,
        open_questions, lockout_fold, code_lifetimes, stream_lockouts, stream_code_lifetimes, gap_sessions, stream_daily_counts, safe_parsing,
    )
}

_DAILY = """
WITH log AS ({log}),
per_day AS (
  SELECT CAST(ts AS DATE) AS day, count(*) AS total, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS uncovered,
         count(DISTINCT user_id) AS dau
  FROM log GROUP BY 1),
calendar AS (
  SELECT CAST(unnest(generate_series((SELECT min(day) FROM per_day), (SELECT max(day) FROM per_day), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(c.day, '%Y-%m-%d') AS day, CAST(coalesce(total, 0) AS BIGINT) AS total,
       CAST(coalesce(uncovered, 0) AS BIGINT) AS uncovered, CAST(coalesce(dau, 0) AS BIGINT) AS dau
FROM calendar c LEFT JOIN per_day p ON c.day = p.day"""

ORACLES = {
    "usage_daily_counts": _DAILY.format(log="SELECT * FROM events"),
    "stream_daily_counts": _DAILY.format(log="SELECT * FROM events"),
    "usage_rolling_range": _DAILY.format(log=f"SELECT * FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 6 DAY"),
    "usage_summary": """
SELECT count(*) AS total, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS uncovered,
       round(coalesce(count(*) FILTER (event_type = 'error') / CAST(nullif(count(*), 0) AS DOUBLE), 0), 6) AS uncovered_ratio
FROM events""",
    "uncovered_latest": """
SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100""",
    "uncovered_with_user": """
SELECT event_id, user_id, coalesce(c_name, 'user #' || user_id) AS user_name
FROM events LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON user_id = c_custkey
WHERE event_type = 'error'""",
    "usage_page": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
    "feedback_fold": """
WITH last AS (
  SELECT user_id,
    max_by(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 0 END, CASE WHEN event_type IN ('click', 'error') THEN (ts, event_id) END) AS feedback,
    max_by(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END, CASE WHEN event_type IN ('purchase', 'error') THEN (ts, event_id) END) AS resolved
  FROM events GROUP BY user_id)
SELECT user_id, CAST(feedback AS INTEGER) AS feedback, CAST(resolved AS INTEGER) AS resolved FROM last""",
    "open_questions": """
SELECT event_id, CAST(event_type <> 'error' AS INTEGER) AS covered, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS INTEGER) AS feedback
FROM events WHERE event_type IN ('error', 'view')""",
    "code_lifetimes": """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) AS sec, event_type = 'signup' AS asks, CAST(floor(value) AS BIGINT) % 3 AS code,
         row_number() OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT), event_id) AS i
  FROM events WHERE event_type IN ('signup', 'error', 'purchase')),
fold AS (
  SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, '' AS outcome, CAST(NULL AS BIGINT) AS sent, CAST(NULL AS BIGINT) AS live, 0 AS tries FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, event_id, i, outcome,
    CASE outcome WHEN 'sent' THEN sec WHEN 'accepted' THEN NULL ELSE sent END, CASE outcome WHEN 'sent' THEN code WHEN 'accepted' THEN NULL ELSE live END,
    CASE outcome WHEN 'sent' THEN 0 WHEN 'wrong' THEN tries + 1 ELSE tries END
  FROM (
    SELECT e.*, f.sent, f.live, f.tries,
      CASE WHEN e.asks THEN CASE WHEN e.sec - f.sent < 21600 THEN 'too_soon' ELSE 'sent' END
        WHEN f.sent IS NULL OR e.sec > f.sent + 172800 OR f.tries >= 2 THEN 'void' WHEN e.code = f.live THEN 'accepted' ELSE 'wrong' END AS outcome
    FROM fold f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, event_id, outcome FROM fold WHERE i > 0""",
    "lockout_fold": """
WITH RECURSIVE attempts AS (
  SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) AS at, event_type = 'purchase' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT), event_id) AS i
  FROM events WHERE event_type IN ('error', 'purchase')),
fold AS (
  SELECT user_id, event_id, i,
         CASE WHEN ok THEN 'passed' ELSE 'failed' END AS outcome,
         CASE WHEN ok THEN 0 ELSE 1 END AS failures, CAST(0 AS BIGINT) AS until
  FROM attempts WHERE i = 1
  UNION ALL
  SELECT a.user_id, a.event_id, a.i,
         CASE WHEN a.at < f.until THEN 'refused' WHEN a.ok THEN 'passed' WHEN f.failures + 1 >= 3 THEN 'locked' ELSE 'failed' END,
         CASE WHEN a.at < f.until THEN f.failures WHEN a.ok OR f.failures + 1 >= 3 THEN 0 ELSE f.failures + 1 END,
         CASE WHEN a.at < f.until THEN f.until WHEN NOT a.ok AND f.failures + 1 >= 3 THEN a.at + 3600 ELSE CAST(0 AS BIGINT) END
  FROM fold f JOIN attempts a ON a.user_id = f.user_id AND a.i = f.i + 1)
SELECT user_id, event_id, outcome FROM fold""",
    "gap_sessions": """
WITH marked AS (
  SELECT *, CASE WHEN CAST(epoch(ts) AS BIGINT) - lag(CAST(epoch(ts) AS BIGINT)) OVER w <= 21600 THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT), event_id)),
numbered AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT), event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM marked)
SELECT user_id, session_no, count(*) AS n_events, min(ts) AS started, max(ts) AS ended FROM numbered GROUP BY ALL""",
    "safe_parsing": """
SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k,
       CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS at_seconds,
       CAST(CASE WHEN event_id % 3 = 0 THEN 500 ELSE event_id % 500 END AS BIGINT) AS sample_count,
       CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS sample_open,
       CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE TRY_CAST(props->>'$.k' AS BIGINT) END AS BIGINT) AS answer_k
FROM events""",
}
ORACLES |= {"stream_lockouts": ORACLES["lockout_fold"], "stream_code_lifetimes": ORACLES["code_lifetimes"]}
