"""Parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_states(spark, path: str) -> tuple:
    """(name, bytes, time of change) of all files under a path, in any store that Spark reads: equal while nothing has changed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(place, True)
    while files.hasNext():
        state = files.next()
        found.append((state.getPath().toString(), state.getLen(), state.getModificationTime()))
    return tuple(sorted(found))
