"""Shared helpers: the shared folder, written tables, row addresses, joins with hot keys, 64-bit mixing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is missing and Spark runs in this one process (tests),
    a folder of this machine is set up for the session; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back.

    This cuts the lineage and survives lost executors; the rows of an empty or
    non-deterministic df are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._millrace_path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote; results that still read them end with it."""
    _delete(spark, _scratch(spark))


def settled(docs: DataFrame) -> DataFrame:
    """docs where it is a plain scan of files, whose rows have fixed addresses; else docs written."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().apply(0)
    if node.nodeName() == "LogicalRelation":
        try:
            docs.metadataColumn("_metadata")
            return docs
        except AnalysisException:
            pass
    return written(docs, "settled")


def addressed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and the address of each row: file (hash of its path) and row (number in it).

    docs: settled. An address is unique and the same in every reading, however
    the files are split.
    """
    meta = docs.metadataColumn("_metadata")
    return docs.select(*columns, F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"))


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined with right on ``key``; right (written) has one row a key, and in ``weight`` left's rows of that key.

    Keys with over a thousandth of all those rows, a thousand keys at most, are told
    apart by a filter and broadcast, so that no task gets a hot key; the others meet
    by a shuffle. Each row of left goes one way, once.
    how: inner or left; rows of left without a key must not be left over.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) > total / 1000).drop(weight)
    # A thousand keys at most: as a filter, they take no join to keep apart.
    kind = hot.schema[key].dataType
    value = lambda v, t: F.struct(*[value(x, f.dataType).alias(f.name) for x, f in zip(v, t, strict=True)]) if isinstance(t, StructType) else F.lit(v).cast(t)
    keys = [value(r[0], kind) for r in hot.select(key).collect()]
    if not keys:
        return left.join(right.drop(weight).hint("merge"), key, how)
    among = lambda: F.coalesce(F.col(key).isin(keys), F.lit(False))
    cold = right.where(~among()).drop(weight)
    return left.where(among()).join(F.broadcast(hot), key).unionByName(left.where(~among()).join(cold.hint("merge"), key, how))


def more_fields(schema: StructType, ddl: str) -> StructType:
    """schema and after it the fields of a DDL string."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
