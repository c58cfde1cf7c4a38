"""Stateful streams against the batch folds, with restarts, failures and expiry of state."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import usage
from quillspark.streaming import attempts
from quillspark.streaming import usage as streams

LOCKS = "user long, event_id long, at long, ok boolean"
CODES = "user long, event_id long, at long, asks boolean, code string"


def events(kind, n=400):
    rng = random.Random(7)
    rows, at = [], 1_000_000
    for i in range(n):
        at += rng.choice([0, 1, 20, 300])
        user = rng.choice([1, 1, 1, 2, 3, None])
        rows.append((user, i, at, rng.choice([True, False, False, False, None])) if kind == "locks" else (user, i, at, rng.random() < 0.3, rng.choice("ab")))
    return rows


FOLDS = {
    "locks": (LOCKS, usage.lockout_fold(3, 700), lambda df: usage.lockouts(df, "user", 3, 700)),
    "forgetful locks": (LOCKS, usage.lockout_fold(3, 700, 400), lambda df: usage.lockouts(df, "user", 3, 700, 400)),
    "codes": (CODES, usage.code_fold(60, 600, 2), lambda df: usage.code_outcomes(df, "user", 60, 600, 2)),
}


def rows_of(df):
    return sorted(map(tuple, df.select("user", "event_id", "outcome").collect()), key=repr)


@pytest.mark.parametrize("kind", FOLDS)
def test_stream_in_slices_gives_the_batch(spark, tmp_path, kind):
    schema, fold, batch = FOLDS[kind]
    df = spark.createDataFrame(events(kind.split()[-1]), schema)
    wanted = rows_of(batch(df))
    assert len({o for *_, o in wanted}) >= 4
    assert rows_of(attempts.outcomes_of_slices(df, "user", fold, str(tmp_path), 3)) == wanted


def test_stream_goes_on_after_a_failure_between_batches(spark, tmp_path):
    schema, fold, batch = FOLDS["codes"]
    rows, got = events("codes"), {}
    for i in range(3):
        spark.createDataFrame(rows[i * 140 : (i + 1) * 140], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(fails):
        def sink(df, batch_id):
            if fails and batch_id == 1:
                raise RuntimeError("sink is down")
            got[batch_id] = [tuple(r) for r in df.select("user", "event_id", "outcome").collect()]

        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with attempts.rocksdb_state(spark):
            attempts.live_outcomes(source, "user", fold).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="sink is down"):
        run(True)
    assert set(got) == {0}
    run(False)
    assert len(got) >= 3
    assert sorted((r for b in got.values() for r in b), key=repr) == rows_of(batch(spark.createDataFrame(rows, schema)))


def kept(spark, folder):
    return {json.loads(r["key"]["_key"]).get("user") for r in spark.read.format("statestore").option("stateVarName", "fold").load(f"{folder}/state").collect()}


@pytest.mark.parametrize("kind", ["forgetful locks", "codes"])
def test_state_goes_with_the_watermark(spark, tmp_path, kind):
    schema, fold, _ = FOLDS[kind]
    first = [(1, 1, 1000, False), (2, 2, 1000, False), (2, 3, 1001, False), (2, 4, 1002, False), (3, 5, 1003, True)] if "locks" in kind else [(1, 1, 1000, True, "a"), (2, 2, 1001, True, "a"), (3, 3, 1002, True, "a"), (3, 4, 1003, False, "a")]
    later = [(9, 8, 90_000, False), (9, 9, 90_001, False)] if "locks" in kind else [(9, 9, 90_000, True, "a")]
    late = [(1, 10, 1500, False)] if "locks" in kind else [(1, 10, 1500, False, "a")]

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        at = attempts.outcomes_to_table(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "user", fold, str(tmp_path))
        return len(spark.read.parquet(at).collect())

    assert add(first) == len(first)
    assert kept(spark, tmp_path) == {1, 2}  # a success and an accepted code leave nothing behind
    assert add(later) == len(first) + len(later)
    assert kept(spark, tmp_path) == {9}
    assert add(late) == len(first) + len(later)  # what comes behind the watermark is left out
    assert kept(spark, tmp_path) == {9}


def test_codes_follow_the_rules(spark):
    """Resent too soon, replaced by a later code, used once, expired, and void after too many wrong tries."""
    def told(*rows):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], CODES)
        return [r["outcome"] for r in usage.code_outcomes(df, "user").orderBy("event_id").collect()]

    assert told((0, True, "x"), (30, True, "y"), (61, True, "z"), (62, False, "x"), (62, False, "z"), (63, False, "z")) == ["sent", "too_soon", "sent", "wrong", "accepted", "void"]
    assert told((0, True, "x"), (601, False, "x"), (700, True, "y"), *[(701, False, "n")] * 5, (702, False, "y")) == ["sent", "void", "sent", *["wrong"] * 5, "void"]


def test_failures_are_forgotten(spark):
    df = spark.createDataFrame([(1, i, at, False) for i, at in enumerate([0, 10, 1000, 1010, 1020, 1030])], LOCKS)
    assert [r["outcome"] for r in usage.lockouts(df, "user", 3, 100, 500).orderBy("event_id").collect()] == ["failed", "failed", "failed", "failed", "locked", "refused"]
    assert [r["outcome"] for r in usage.lockouts(df, "user", 3, 100).orderBy("event_id").collect()] == ["failed", "failed", "locked", "refused", "refused", "refused"]


def test_days_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Files in turn, with a restart for each: users of a day count once over all of them, and only closed days come out."""
    rng = random.Random(3)
    schema = "ts timestamp_ntz, user_id long, kind string"
    base = datetime.datetime(2024, 3, 1)
    rows = sorted(((base + datetime.timedelta(hours=rng.randrange(24 * 9)), rng.choice([1, 2, 3, 4, None]), rng.choice(["ok", "error"])) for _ in range(400)), key=lambda r: r[0])
    folder, bad = str(tmp_path / "log"), "kind = 'error'"

    def add(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        counted = streams.daily_counts(spark.readStream.schema(schema).parquet(folder), bad)
        out = spark.read.schema(counted.schema).parquet(streams.run_to_table(counted, str(tmp_path / "work"))).collect()
        assert len(out) == len({r["day"] for r in out})
        return {str(r["day"]): (r["total"], r["uncovered"], r["dau"]) for r in out}

    table = spark.createDataFrame(rows, schema)
    want = {r["day"]: (r["total"], r["uncovered"], r["dau"]) for r in usage.daily_counts(table, F.expr(bad)).collect()}
    first = add(rows[:150])
    assert 0 < len(first) < 4 and first.items() <= want.items()
    second = add(rows[150:])
    assert len(second) == 6 and second.items() <= want.items()  # two days late, and the last one open
    table.write.parquet(str(tmp_path / "whole" / "log.parquet"))
    closed = streams.daily_counts_of_files(spark, str(tmp_path / "whole"), "log", bad)
    assert {r["day"]: (r["total"], r["uncovered"], r["dau"]) for r in closed.collect()} == want
