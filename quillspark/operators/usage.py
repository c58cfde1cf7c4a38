"""Usage metrics over an activity log: day counts, coverage, feedback and paging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def count_where(condition: Column) -> Column:
    """How many rows meet condition; zero for no rows."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def daily_counts(log: DataFrame, uncovered: Column, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """One row for each day from the first to the last: total, uncovered, dau; days without rows count zero.

    Null users are no one's activity. The calendar is built from two values, so only day counts are joined.
    """
    per_day = log.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("total"), count_where(uncovered).alias("uncovered"), F.countDistinct(user).alias("dau")
    )
    span = log.agg(F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("last")).where("first is not null")
    calendar = span.select(F.explode(F.sequence("first", "last")).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return calendar.join(per_day, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), zero("total"), zero("uncovered"), zero("dau"))


def summary(log: DataFrame, uncovered: Column) -> DataFrame:
    """total, uncovered and their ratio, which is zero for an empty log."""
    counts = log.agg(F.count("*").alias("total"), count_where(uncovered).alias("uncovered"))
    return counts.withColumn("uncovered_ratio", F.round(F.coalesce(F.try_divide(F.col("uncovered").cast("double"), F.col("total")), F.lit(0.0)), 6))


def within_days(log: DataFrame, now: str, days: int, ts: str = "ts") -> DataFrame:
    """Rows since now less (days - 1) times 86,400 seconds. The cut is not aligned to days, so the first day is partial."""
    cut = F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.lit((days - 1) * 86400)).cast("timestamp_ntz")
    return log.where(F.col(ts) >= cut)


def latest(log: DataFrame, condition: Column, n: int, order: list[Column]) -> DataFrame:
    return log.where(condition).orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The rows of one page, counted from 1; a number past the end gives the last page.

    Only page bounds come from the whole table; the page itself is a top-n, not a total sort.
    """
    total = df.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def fold_flags(events: DataFrame, key: str, order: list[str], flags: dict[str, Column]) -> DataFrame:
    """Latest value of each flag per key: flags names the flag and the value that an event sets (null: none)."""
    seq = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(value, F.when(value.isNotNull(), seq)).alias(name) for name, value in flags.items()])


def gap_sessions(df: DataFrame, key: str, ts: str, gap: float, tie: str) -> DataFrame:
    """Number the groups of each key's values in which no step exceeds gap (a number in ts's unit)."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    started = F.when(F.col(ts) - F.lag(ts).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", started).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def with_user_names(log: DataFrame, users: DataFrame, key: str, user_key: str, name: str) -> DataFrame:
    """log with user_name; a user without a name is called by the key."""
    named = users.select(F.col(user_key).alias("_user"), F.col(name).alias("_name"))
    joined = log.join(named, F.col(key) == F.col("_user"), "left")
    return joined.withColumn("user_name", F.coalesce("_name", F.concat(F.lit("user #"), F.col(key).cast("string")))).drop("_user", "_name")


def is_uncovered(covered: str, feedback: str) -> Column:
    """Not covered, or said to be unhelpful; no feedback (null) is not negative feedback."""
    return (F.col(covered) == 0) | F.coalesce(F.col(feedback) == 0, F.lit(False))


@dataclass(frozen=True)
class Fold:
    """What a keyed fold does with one event: step(state, *columns) changes the state, a list, and gives the outcome.

    columns: `at` and what else of an event step takes. fresh: the state of a key without events. fields: the
    state's fields as a schema. matters_until: the last second at which a state can still change an outcome, 0 for
    one that never can, None for one that always can.
    """

    columns: tuple[str, ...]
    fresh: tuple
    fields: str
    step: Callable[..., str]
    matters_until: Callable[[list], int | None]


def lockout_fold(max_failures: int = 5, lock_seconds: int = 900, forget_seconds: int | None = None) -> Fold:
    """Outcomes passed, failed, locked or refused of attempts (at, ok): see lockouts."""

    def step(state: list, at: int | None, ok: bool | None) -> str:
        failures, until, last = state
        if at is not None and at < until:
            return "refused"
        if forget_seconds is not None and at is not None and at - last > forget_seconds:
            failures = 0
        state[2] = last if at is None else at
        if ok:
            state[:2] = 0, 0
            return "passed"
        if failures + 1 >= max_failures:
            state[:2] = 0, at + lock_seconds if at is not None else until
            return "locked"
        state[0] = failures + 1
        return "failed"

    def matters_until(state: list) -> int | None:
        failures, until, last = state
        if failures and forget_seconds is None:
            return None
        return max(until, last + forget_seconds if failures else 0)

    return Fold(("at", "ok"), (0, 0, 0), "failures int, until long, last long", step, matters_until)


def lockouts(attempts: DataFrame, key: str, max_failures: int = 5, lock_seconds: int = 900, forget_seconds: int | None = None) -> DataFrame:
    """(key, event_id, outcome) of attempts (key, event_id, at in seconds, ok): passed, failed, locked or refused.

    max_failures failures in a row lock the key; attempts until lock_seconds later are refused and change
    nothing. The counter starts anew after a lock, after a success and, with forget_seconds, after so long a time
    without an attempt. Attempts are sorted by key and time and folded as they stream by, so a task holds one
    batch and one key's counter, however long a history is. A null ok is a failure; attempts without a time come
    last and are never refused; null keys are one key.
    """
    return _folded(attempts, key, lockout_fold(max_failures, lock_seconds, forget_seconds))


def code_fold(resend_seconds: int = 60, live_seconds: int = 600, max_tries: int = 5) -> Fold:
    """Outcomes sent, too_soon, accepted, wrong or void of events (at, asks, code): see code_outcomes."""

    def step(state: list, at: int | None, asks: bool | None, code: str | None) -> str:
        sent, live, tries = state
        if at is None:
            return "void"
        if asks:
            if sent is not None and at - sent < resend_seconds:
                return "too_soon"
            state[:] = at, code, 0
            return "sent"
        if sent is None or at > sent + live_seconds or tries >= max_tries:
            return "void"
        if code == live:
            state[:] = None, None, 0
            return "accepted"
        state[2] += 1
        return "wrong"

    return Fold(("at", "asks", "code"), (None, None, 0), "sent long, code string, tries int", step, lambda state: 0 if state[0] is None else state[0] + max(live_seconds, resend_seconds))


def code_outcomes(events: DataFrame, key: str, resend_seconds: int = 60, live_seconds: int = 600, max_tries: int = 5) -> DataFrame:
    """(key, event_id, outcome) of events (key, event_id, at in seconds, asks, code): sent, too_soon, accepted, wrong or void.

    An event that asks gets a new code, unless the key's last one was sent less than resend_seconds before. Any other
    tries a code: it is void without a code, past live_seconds, or after max_tries wrong ones; the right code is
    accepted once. Events are folded in the order of time and event_id, see lockouts; those without a time are void
    and change nothing; null keys are one key.
    """
    return _folded(events, key, code_fold(resend_seconds, live_seconds, max_tries))


def _folded(rows: DataFrame, key: str, fold: Fold) -> DataFrame:
    """(key, event_id, outcome): the fold over each key's rows in the order of at and event_id."""
    ordered = rows.select(key, "event_id", *fold.columns).repartition(F.col(key)).sortWithinPartitions(F.col(key), F.asc_nulls_last("at"), "event_id")

    def outcomes_of(batches):
        current, state = object(), list(fold.fresh)
        for batch in batches:
            outcomes = []
            for who, *values in zip(*(batch.column(c).to_pylist() for c in (key, *fold.columns)), strict=True):
                if who != current:
                    current, state = who, list(fold.fresh)
                outcomes.append(fold.step(state, *values))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("event_id"), pa.array(outcomes, pa.string())], [key, "event_id", "outcome"])

    return ordered.mapInArrow(outcomes_of, T.StructType([ordered.schema[key], ordered.schema["event_id"], T.StructField("outcome", T.StringType())]))


def sample_count(text: Column) -> Column:
    """struct<sample_count: long, sample_open: int> of `120` or `500+`; what is no number counts zero."""
    digits = F.coalesce(F.regexp_extract(F.trim(text), r"^(\d+)\+?$", 1).try_cast("long"), F.lit(0).cast("long"))
    return F.struct(digits.alias("sample_count"), F.when(F.trim(text).rlike(r"^\d+\+$"), 1).otherwise(0).alias("sample_open"))


def epoch_or_zero(text: Column) -> Column:
    """Seconds of `yyyy-MM-dd HH:mm:ss`; what cannot be read is zero, not null."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0).cast("long"))


def first_json_object(text: Column, schema: str) -> Column:
    """The first {...} in a text parsed by schema; null where there is none or it is malformed."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def parsed_fields(events: DataFrame) -> DataFrame:
    """Lenient parsing shown on made-up raw fields of events: times, counts with a plus sign, JSON inside prose."""
    raw_time = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    raw_count = F.when(F.col("event_id") % 3 == 0, "500+").otherwise((F.col("event_id") % 500).cast("string"))
    raw_answer = F.when(F.col("event_id") % 4 == 0, "no answer").otherwise(F.concat(F.lit("Sure: "), F.col("props"), F.lit(" - done")))
    return events.select(
        "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), epoch_or_zero(raw_time).alias("at_seconds"),
        sample_count(raw_count).alias("s"), first_json_object(raw_answer, "k long")["k"].alias("answer_k"),
    ).select("event_id", "k", "at_seconds", "s.sample_count", "s.sample_open", "answer_k")
