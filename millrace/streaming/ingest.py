"""Ingest as a stream: every micro-batch of files is classified against the state before it, and is one version.

A batch that is run again, as after a lost driver, has the number it had before.
It reads the state before that number and writes over what it wrote, so nothing
comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import index
from millrace.plans import build
from millrace.sources import files

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
_MANIFEST = "source_path string, file_hash string, at timestamp, batch long"


def _scanned(batch: DataFrame) -> DataFrame:
    """source_path, content, file_hash and at of a batch's supported files; of a path that comes twice, the last."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.col("modificationTime").desc(), F.sha2("content", 256)))
    rows = batch.where(files.extension(F.col("path")).isin(*files.EXTENSIONS)).withColumn("_n", last).where("_n = 1")
    plain = F.regexp_replace("path", "^file:/+", "file:/").alias("source_path")
    return rows.select(plain, "content", F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("at"))


def _stream(spark: SparkSession, raw_dir: str, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    stream = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").load(raw_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(spark: SparkSession, raw_dir: str, manifest_path: str, checkpoint: str, changed: Callable[[DataFrame, DataFrame], None]) -> StreamingQuery:
    """Watches raw_dir; changed(files, changes) gets each batch's new and changed files.

    A batch's rows of the manifest are written last, as its commit mark, and under
    its number. A file seen again with the same hash is skipped. Deletions are
    found by ``index_stream`` or a full scan.
    """
    return _stream(spark, raw_dir, checkpoint, ingest_batch(spark, manifest_path, changed))


def ingest_batch(spark: SparkSession, manifest_path: str, changed: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """What ``ingest_files`` does with a batch and its number."""

    def batch(rows: DataFrame, number: int) -> None:
        scan, old = _scanned(rows), latest_manifest(spark, manifest_path, number)
        changes = index.classify(scan, old).where("status in ('new', 'changed')")
        fresh = scan.join(changes.select("source_path", "status"), "source_path")
        changed(fresh, changes)
        fresh.select("source_path", "file_hash", "at").write.mode("overwrite").parquet(f"{manifest_path}/batch={number}")

    return batch


def latest_manifest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """source_path and its last file_hash, or those before a batch; empty before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema(_MANIFEST).parquet(path) if exists else spark.createDataFrame([], _MANIFEST)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("source_path").agg(F.max_by("file_hash", F.struct("batch", "at")).alias("file_hash"))


def index_stream(spark: SparkSession, raw_dir: str, index_dir: str, checkpoint: str, **settings) -> StreamingQuery:
    """Keeps an index up to date from a folder: batch n is the index's version n + 1.

    settings go to build.write_version. Files that are gone when a batch runs are
    removed with it; where no new file comes, build_index finds deletions. An index
    is written by one stream, or by build_index, not by both at a time.
    """
    return _stream(spark, raw_dir, checkpoint, index_batch(spark, raw_dir, index_dir, **settings))


def index_batch(spark: SparkSession, raw_dir: str, index_dir: str, **settings) -> Callable[[DataFrame, int], None]:
    """What ``index_stream`` does with a batch and its number."""

    def batch(rows: DataFrame, number: int) -> None:
        scan = _scanned(rows).drop("at")
        known = build.manifest(spark, index_dir, number)
        here = files.listing(spark, raw_dir).select("source_path")
        # Of the indexed files that this batch doesn't bring, those that are gone.
        gone = known.join(here, "source_path", "left_anti").join(scan.select("source_path"), "source_path", "left_anti")
        touched = known.join(scan.select("source_path"), "source_path", "left_semi").unionByName(gone)
        build.write_version(spark, raw_dir, index_dir, number + 1, scan, index.classify(scan, touched), **settings)

    return batch


def audit_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only JSON sink."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
