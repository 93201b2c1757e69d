"""Places and running sums within groups of any size.

Rows are dealt out by range of group and order, so that a group with a third of
all rows lies over many tasks in turn. Each task numbers its own rows; what a
group has in the tasks before is a table with a row for each task that a group
of several tasks touches, so its size follows the number of tasks, not that of
the rows. Sums are of 64 bits and wrap around.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, more_fields, written


def _local(groups: Sequence[str], weight: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, plain, ranked = None, 0, np.int64(0), np.int64(0)
        for b in batches:
            if not b.num_rows:
                continue
            g = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in groups], 1)
            w = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.append(last is None or (g[0] != last).any(), (g[1:] != g[:-1]).any(1))
            start = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1  # -1: still the group of the batch before
            first = np.append(-n, start)[run_of + 1]
            rank = np.arange(len(g), dtype=np.int64) - first + 1

            def running(x: np.ndarray, carried: np.int64, start=start, run_of=run_of) -> np.ndarray:
                total = np.cumsum(x)
                base = np.append(-carried, total[start] - x[start])
                return total - base[run_of + 1]

            sums = running(w, plain), running(w * rank, ranked)
            last, n, plain, ranked = g[-1], int(rank[-1]), sums[0][-1], sums[1][-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())], names=[*b.schema.names, "_rank", "_plain", "_ranked"])

    return run


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """df with ``rank`` (from 1 within the group, in the order) and ``total``, the sum of rank * weight over the ranks up to it.

    groups: columns of longs without nulls. order: columns that tell the rows of a
    group apart; rows that they don't tell apart are ranked in any order. weight: a
    column of longs without nulls. df's columns must not begin with _.
    """
    spark, groups = df.sparkSession, list(groups)
    rows = df.withColumn("_weight", F.col(weight) if weight else F.lit(0).cast("long"))
    by_range = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *groups, *order).sortWithinPartitions(*groups, *order)
    placed = by_range.mapInArrow(_local(groups, "_weight"), more_fields(by_range.schema, "_rank long, _plain long, _ranked long"))
    # The task's number is kept with the rows: whichever task reads them later, it tells the range.
    local = written(placed.withColumn("_part", F.spark_partition_id()), "ranked")
    ends = local.groupBy(*groups, "_part").agg(F.max(F.struct("_rank", "_plain", "_ranked")).alias("last"))
    # Of a task, only the first and the last group go on in another one.
    several = ends.groupBy(*groups).agg(F.min("_part").alias("a"), F.max("_part").alias("z")).where("a <> z")
    wide = ends.join(several, groups, "left_semi").select(*groups, "_part", "last.*")

    def before(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_part")
        n, plain, ranks = (t[c].to_numpy(np.int64) for c in ("_rank", "_plain", "_ranked"))
        ahead = np.cumsum(n) - n
        sums = ranks + ahead * plain
        return t[[*groups, "_part"]].assign(_ahead=ahead, _sum=np.cumsum(sums) - sums)

    carried = wide.groupBy(*groups).applyInPandas(before, more_fields(wide.select(*groups, "_part").schema, "_ahead long, _sum long"))
    carried = written(carried, "carried")
    # At most two rows for each task that wrote.
    out = local.join(F.broadcast(carried), [*groups, "_part"], "left").fillna(0, ["_ahead", "_sum"])

    @F.pandas_udf("long")
    def wrapped(total: pd.Series, ranks: pd.Series, ahead: pd.Series, plain: pd.Series) -> pd.Series:
        return pd.Series(total.to_numpy() + ranks.to_numpy() + ahead.to_numpy() * plain.to_numpy())

    total = [wrapped("_sum", "_ranked", "_ahead", "_plain").alias("total")] if weight else []
    result = written(out.select(*df.columns, (F.col("_rank") + F.col("_ahead")).alias("rank"), *total), "ranks")
    dropped(local, carried)
    return result
