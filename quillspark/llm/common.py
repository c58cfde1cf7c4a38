"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only where the session names neither (a local run or a test) one is made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder, with the writer's options, and read it again; cuts the lineage.

    Lost executors cost nothing that was stored. Tables go when the driver ends in order; after a crash the
    folder's owner removes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table that stored() wrote for df; nothing that is still to run may read it."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores before it as it takes to be no column of any of frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """While it lasts, what runs sends Python so many rows at once; for columns of large values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_bucket(column: str, n: int):
    """crc32 of the column's text modulo n: the fold that decides whether a row's label may be learned from."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n).cast("long"))


def numbered(df: DataFrame, group: list[str], order: list[str], place: str = "pos", size: str = "rows") -> DataFrame:
    """df with `place`, a row's number from 0 in its group by order, and `size`, the rows of the group; stores df once.

    Rows are sorted by range, so a group of any share of them is spread over tasks. Only how many rows of a group
    each part holds goes through windows: parts and groups together, not rows. Names must be free in df, as must
    `_at` and `_part`. Order must tell rows apart, but for those whose numbers may be exchanged.
    """
    keys = [*group, *order]
    at = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    at = at.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    parts = at.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    per = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(per.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = parts.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(per).alias(size))
    return at.join(parts, [*group, "_part"]).withColumn(place, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
