"""Streaming forms of the usage metrics."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.usage import count_where
from quillspark.sources.tables import load


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, removed when the driver ends; a temporary one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{named or tempfile.mkdtemp(prefix='quillspark-')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return folder


def keeper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that stores a query's own small table in a folder that driver and executors share, and reads it again."""

    def keep(df: DataFrame) -> DataFrame:
        folder = work_folder(spark, "kept")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    return keep


#: What closes a log: an event so late that every day before it is over.
END_OF_LOG = "9999-01-01 00:00:00"


def daily_counts(log: DataFrame, uncovered: str, late: str = "2 days", ts: str = "ts") -> DataFrame:
    """(day, total, uncovered, dau) of a stream of activity, for each day once it is over by the watermark on ts (cast to a timestamp).

    Two aggregations in a row: rows by day and user, whose states are the distinct users of the days that are still
    open, and then days. Null users are counted as rows and are no one. Events that come later than `late` behind
    the newest are left out.
    """
    timed = log.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    users = timed.groupBy(F.window("_at", "1 day").alias("w"), "user_id").agg(F.count("*").alias("total"), count_where(F.expr(uncovered)).alias("uncovered"))
    days = users.groupBy(F.window(F.window_time("w"), "1 day").alias("d")).agg(F.sum("total").alias("total"), F.sum("uncovered").alias("uncovered"), F.count("user_id").alias("dau"))
    return days.select(F.to_date("d.start").alias("day"), "total", "uncovered", "dau")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> str:
    """Run a stream over what is there now into a Parquet table; a restart goes on from its checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{folder}/table"


def daily_counts_of_files(spark: SparkSession, folder: str, name: str, uncovered: str, ts: str = "ts") -> DataFrame:
    """Day counts of a Parquet table read as a stream of files: the batch result, by the stream alone.

    What the stream has read leaves its last days open. A closing batch, one event at END_OF_LOG, moves the
    watermark past them; it is no part of any day that is counted. Days without rows are filled in afterwards.
    """
    schema, work = load(spark, folder, name).schema, work_folder(spark, "daily")
    closing = f"{work}/closing"
    spark.createDataFrame([], schema).write.parquet(closing)

    def run() -> DataFrame:
        stream = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*").unionByName(spark.readStream.schema(schema).parquet(closing))
        counted = daily_counts(stream, uncovered, ts=ts)
        return spark.read.schema(counted.schema).parquet(run_to_table(counted, work))

    run()
    spark.range(1).select(*[(F.lit(END_OF_LOG) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(closing)
    days = run()
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null")
    calendar = span.select(F.explode(F.sequence("first", "last")).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return calendar.join(days, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), zero("total"), zero("uncovered"), zero("dau"))
