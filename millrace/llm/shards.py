"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly into buckets by a seeded hash of each
row's address; the number of buckets follows the data, so a bucket fits in
memory, and each bucket is a partition of its own. Pass two puts one bucket at a
time into a canonical order, shuffles it by Fisher and Yates with a seed of its
own, and writes it. Shards are equal runs of the written sequence: their row
counts differ by at most one.

The hash takes the row's address (file and number in it) and not its content, so
no key, source or group of copies can fill a bucket, and a row's bucket is the
same however often and in whatever splits the files are read: a lost executor
repeats its part with the same result. What isn't a plain scan of files is
written first. What follows reads the written table.

Defined results: null texts and ids are carried as they are (size 16, checksum
0); repeated rows are separate rows; an empty table gives no rows; other
columns are carried only where named, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import addressed, settled, written

OVERHEAD = 16


def record_size(text_col: str = "text"):
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + OVERHEAD).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n); numpy's shuffle is Fisher and Yates's."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def shuffled_shards(docs: DataFrame, n_shards: int = 40, seed: int = 17, bucket_bytes: int = 64 << 20, text_col: str = "text", columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The columns of every row with shard (int) and slot (long, from 0 in each shard).

    The rows are moved once and written once. Of the corpus, the driver sees
    only two sums and one count per bucket.
    """
    spark = docs.sparkSession
    docs = settled(docs)
    total = docs.agg(F.coalesce(F.sum(record_size(text_col)), F.lit(0)).alias("bytes")).first()["bytes"]
    n_buckets = max(n_shards, -(-total // bucket_bytes))
    names = [f"c{k}" for k in range(len(columns))]
    placed = addressed(docs, *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    bucket = F.pmod(F.xxhash64(F.lit(seed), "file", "row"), F.lit(n_buckets)).cast("int")
    placed = placed.withColumn("_bucket", bucket).repartitionById(n_buckets, "_bucket")

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("file", "ascending"), ("row", "ascending")])
        order = fisher_yates(table.num_rows, seed, table["_bucket"][0].as_py())
        at = np.arange(table.num_rows, dtype=np.int64)
        for k in range(0, table.num_rows, 2000):
            some = table.select([*names, "_bucket"]).take(pa.array(order[k : k + 2000]))
            yield from some.append_column("_pos", pa.array(at[k : k + 2000])).combine_chunks().to_batches()

    table = written(placed.mapInArrow(shuffle, placed.select(*names, "_bucket").schema.add("_pos", "long")), "shuffled")
    counts = sorted((r["_bucket"], r["n"]) for r in table.groupBy("_bucket").agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([n for _, n in counts]).tolist()
    rows = ends[-1] if ends else 1
    begins = spark.createDataFrame([(b, e - n) for (b, n), e in zip(counts, ends, strict=True)], "_bucket int, _begin long")
    at = (F.col("_begin") + F.col("_pos")).alias("_g")
    out = table.join(F.broadcast(begins), "_bucket").select(*names, at)
    out = out.withColumn("shard", F.expr(f"(({n_shards}L * (_g + 1) - 1) div {rows}L)")).withColumn("slot", F.expr(f"_g - ((shard * {rows}L) div {n_shards}L)"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)], F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder per shard, without a shuffle: a bucket's rows lie in neighbouring shards."""
    shards.write.partitionBy("shard").parquet(path)
