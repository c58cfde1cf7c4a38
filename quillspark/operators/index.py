"""Incremental index: differences by content hash, upserts and deletes as new versions of a table."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(scan: DataFrame, current: DataFrame, file: str, digest: str) -> DataFrame:
    """(file, state): new, updated, unchanged or removed, of scanned and indexed files with their hashes."""
    a = scan.select(F.col(file).alias("file"), F.col(digest).alias("_a"), F.lit(1).alias("_in_a"))
    b = current.select(F.col(file).alias("file"), F.col(digest).alias("_b"), F.lit(1).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "new").when(F.col("_in_a").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return a.join(b, "file", "full_outer").select("file", state.alias("state"))


def merge(current: DataFrame, fresh: DataFrame, file: str, id: str, states: DataFrame) -> DataFrame:
    """The next version of an index: fresh chunks of new and updated files, and the current ones of unchanged files.

    Stale ids go with their file's old chunks, and removed files with theirs.
    """
    keep = states.where("state = 'unchanged'").select(F.col("file").alias("_keep"))
    kept = current.join(keep, F.col(file) == F.col("_keep"), "left_semi")
    changed = states.where("state IN ('new', 'updated')").select(F.col("file").alias("_new"))
    return kept.unionByName(fresh.join(changed, F.col(file) == F.col("_new"), "left_semi")).dropDuplicates([id])


def stale_ids(current: DataFrame, fresh: DataFrame, id: str) -> DataFrame:
    return current.select(id).join(fresh.select(id), id, "left_anti")


def catalogue(chunks: DataFrame, file: str, n: str, columns: list[str]) -> DataFrame:
    """One row a file with the columns of its first chunk."""
    first = F.min_by(F.struct(*columns), n)
    return chunks.groupBy(file).agg(first.alias("m"), F.count("*").alias("chunks")).select(file, *[f"m.{c}" for c in columns], "chunks")


class VersionedTable:
    """A Parquet table that is replaced whole: a version is written first and then named, so readers see one or the other.

    The name of the newest version is the greatest of the folder's `v` partition values that is marked done.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in names if fs.exists(done(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.folder}/v={known[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        """Write df as the next version; what fails before its end is never read."""
        number = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        return number


class BucketedTable:
    """A Parquet table in buckets by a hash of its key, of which a key may have any number of rows, such as a file's chunks.

    A change rewrites the buckets that it touches and then names them all at once, so readers see it whole or not at
    all. There is one writer at a time: of two at once, the one that names its buckets last undoes the other's.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.names = VersionedTable(spark, f"{self.folder}/names")

    def _named(self) -> tuple[dict[int, str], int]:
        """The path of each bucket, and the last batch that was applied."""
        named = self.names.read()
        rows = [] if named is None else named.collect()
        return {r["bucket"]: r["path"] for r in rows if r["path"] is not None}, max((r["batch"] for r in rows), default=-1)

    def paths(self) -> dict[int, str]:
        return self._named()[0]

    def read(self) -> DataFrame | None:
        paths = self.paths()
        return self.spark.read.parquet(*paths.values()) if paths else None

    def upsert(self, rows: DataFrame) -> None:
        """Replace the rows of rows' keys; what fails before its end is never read."""
        self.apply(rows, None)

    def apply(self, rows: DataFrame, removed: DataFrame | None, batch: int | None = None) -> bool:
        """In one step, rows replace all rows of their keys and the keys in removed (key) go; whether anything was done.

        batch: the change's number. One that is not greater than the last one applied is passed over, so a batch
        that is run again after its end changes nothing, and one that failed before it is done from the start.
        """
        paths, last = self._named()
        if batch is not None and batch <= last:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        gone = rows.select(self.key) if removed is None else rows.select(self.key).unionByName(removed.select(self.key))
        touched = [r[0] for r in gone.select(bucket).distinct().collect()]
        old = [paths[b] for b in touched if b in paths]
        merged = rows
        if old:
            merged = self.spark.read.parquet(*old).join(gone, self.key, "left_anti").unionByName(rows)
        if touched or batch is not None:
            named = paths
            if touched:
                run = f"{self.folder}/data/{uuid.uuid4().hex}"
                merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(run)
                filled = {p.rsplit("=", 1)[1] for p in self._folders(run) if "_bucket=" in p}
                # A bucket that has lost all its rows has no folder and no name.
                named = {b: p for b, p in paths.items() if b not in touched} | {b: f"{run}/_bucket={b}" for b in touched if str(b) in filled}
            rows_of_names = [(b, p, last if batch is None else batch) for b, p in sorted(named.items())] or [(0, None, last if batch is None else batch)]
            self.names.write(self.spark.createDataFrame(rows_of_names, "bucket int, path string, batch long").coalesce(1))
        return True

    def _fs(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _folders(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return [s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []

    def clean(self, keep_seconds: float = 86_400) -> int:
        """Remove the folders of buckets that no name leads to and versions of names but the last, if they are older; how many.

        Readers that began longer ago than keep_seconds may find their files gone.
        """
        used = {p.rsplit("/", 2)[1] for p in self.paths().values()}
        last = self.names.versions()[-1:]
        old = [p for p in self._folders(f"{self.folder}/data") if p.rsplit("/", 1)[1] not in used]
        old += [p for p in self._folders(f"{self.folder}/names") if p.rsplit("=", 1)[1] not in map(str, last)]
        dropped = 0
        for folder in old:
            fs, path = self._fs(folder)
            if fs.getFileStatus(path).getModificationTime() <= (time.time() - keep_seconds) * 1000:
                dropped += fs.delete(path, True)
        return dropped


def upsert_stream(stream: DataFrame, table: BucketedTable, order: str, state: str) -> None:
    """Run what is new of a file stream into a table: each micro-batch replaces the rows of its keys.

    Within a batch a key's last row by order counts. state is the folder of the stream's progress: another call with
    it goes on where the last one ended, and a batch that is run again gives the same rows.
    """

    def step(batch: DataFrame, _: int) -> None:
        table.upsert(batch.groupBy(table.key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*"))

    stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def change_stream(changes: DataFrame, table: BucketedTable, order: str, removed: str, state: str) -> None:
    """Run what is new of a stream of changes into a table: new versions of keys with all their rows, and removals.

    changes has the table's columns, order (the version of a key's rows, all of which come in one file or batch) and
    removed (boolean: this version of the key is that it is gone). Of several versions of a key in a batch the
    last counts. A version replaces all that the table has of the key, so no row of an earlier one is left over.
    state is the stream's progress; batches are applied once each by their numbers, also where one is run again.
    """

    def step(batch: DataFrame, number: int) -> None:
        latest = batch.withColumn("_last", F.max(order).over(Window.partitionBy(table.key))).where(F.col(order) == F.col("_last"))
        gone = F.coalesce(F.col(removed), F.lit(False))
        table.apply(latest.where(~gone).drop("_last", order, removed), latest.where(gone).select(table.key), number)

    changes.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
