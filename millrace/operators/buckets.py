"""A keyed table in buckets: an upsert or delete writes the buckets that it hits, and no others.

A row's bucket is a hash of its key. Rows lie in folders by the version that wrote
them and by bucket; a small log has, for each version, the buckets that it wrote,
and is written last, as the version's commit mark. A bucket is what the last
version that hit it wrote: its files are never rewritten in place, so readers of an
earlier version are not disturbed, and a version that is run again writes over what
it wrote. A change without rows is no version. What goes through the driver is one row a bucket.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.functions.folders import kept

_LOG = "bucket int, rows long, version int"
_OWN = ("bucket", "version")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a key, by MD5, so that any engine can tell it; null is a value of its own."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class BucketTable:
    """The table in a folder, which ``create`` has set up. Keys may be null and equal keys may repeat."""

    def __init__(self, spark: SparkSession, path: str):
        meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
        self.spark, self.path, self.keys, self.buckets = spark, path, meta["keys"], meta["buckets"]
        self.schema = StructType.fromJson(meta["schema"])

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> BucketTable:
        """Writes rows as version 1. Choose buckets so that one holds a few hundred MB of rows."""
        spark = rows.sparkSession
        if buckets < 1 or not keys or set(_OWN) & set(rows.columns):
            raise ValueError("a table has a bucket or more, keys, and no columns named bucket or version")
        meta = json.dumps({"keys": list(keys), "buckets": buckets, "schema": rows.schema.jsonValue()})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        table = cls(spark, path)
        table._commit(rows.withColumn("bucket", bucket_of(keys, buckets)), range(buckets), 1)
        return table

    def log(self, upto: int | None = None) -> dict[int, tuple[int, int]]:
        """Of each bucket the version that holds it and its number of rows."""
        rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        rows = rows if upto is None else rows.where(F.col("version") <= upto)
        last = rows.groupBy("bucket").agg(F.max_by(F.struct("version", "rows"), "version").alias("l")).select("bucket", "l.*")
        return {r["bucket"]: (r["version"], r["rows"]) for r in last.collect()}

    def version(self) -> int:
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log").agg(F.max("version").alias("v")).first()["v"]

    def read(self, upto: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows, with bucket and the version that wrote it; of all buckets, or of some."""
        wanted = None if only is None else set(only)
        held = {b: v for b, (v, n) in self.log(upto).items() if n and (wanted is None or b in wanted)}
        whole = self._with("version", "bucket")
        if not held:
            return self.spark.createDataFrame([], whole)
        folders = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/rows").parquet(*folders)

    def upsert(self, new: DataFrame, order: str | None = None, version: int | None = None) -> int:
        """new's rows over those of equal keys, as one version.

        Within new, the last by ``order`` wins (of equal ones any); without it, all
        rows of a key stay. new has the table's columns, in any order, and may have
        more, which are left out but for ``order``.
        """
        version = version or self.version() + 1
        new = new.withColumn("bucket", bucket_of(self.keys, self.buckets))
        if order is not None:
            rank = F.row_number().over(Window.partitionBy("bucket", *self._quoted()).orderBy(F.col(f"`{order}`").desc()))
            new = new.withColumn("_rank", rank).where("_rank = 1")
        new = kept(new.select(*[f"`{c}`" for c in self.schema.names], "bucket"), "upsert")
        hit = self._hit(new)
        if not hit:
            return version - 1
        old = self.read(version - 1, hit).drop("version")
        return self._commit(self._without(old, new).unionByName(new), hit, version)

    def delete(self, gone: DataFrame, version: int | None = None) -> int:
        """The rows of the keys in gone go, as one version."""
        version = version or self.version() + 1
        gone = kept(gone.withColumn("bucket", bucket_of(self.keys, self.buckets)).select(*self._quoted(), "bucket").distinct(), "delete")
        hit = self._hit(gone)
        if not hit:
            return version - 1
        return self._commit(self._without(self.read(version - 1, hit).drop("version"), gone), hit, version)

    def _with(self, *names: str) -> StructType:
        return StructType([*self.schema.fields, *(StructField(n, IntegerType()) for n in names)])

    def _quoted(self) -> list[str]:
        return [f"`{k}`" for k in self.keys]

    def _hit(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most one row a bucket

    def _without(self, old: DataFrame, keys: DataFrame) -> DataFrame:
        """old, of the buckets hit, without the rows of some keys; few keys are broadcast by Spark's own measure, so old stays where it is."""
        own = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(self.keys)]
        gone, on = keys.select(F.col("bucket").alias("_b"), *own), F.col("bucket") == F.col("_b")
        for i, k in enumerate(self.keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
        return old.join(gone, on, "left_anti")

    def _commit(self, rows: DataFrame, hit: Sequence[int], version: int) -> int:
        """Writes a version's buckets; those that are left empty are in the log with 0 rows."""
        at = f"{self.path}/rows/version={version}"
        # A bucket to a task, and one that is too large to several.
        rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(at)
        named = self.spark.createDataFrame([(int(b),) for b in hit], "bucket int")
        wrote = self.spark.read.schema(self._with("bucket")).parquet(at).groupBy("bucket").agg(F.count("*").alias("rows"))
        log = named.join(wrote, "bucket", "left").na.fill(0, ["rows"])
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
        return version
