"""Spreading the rows of a small scan over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly where Spark would read it in fewer tasks than there are cores; else as it is.

    For work that takes long on each row. Only a plain scan is dealt out: other
    plans have been dealt out before. The scan is planned, not run.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().apply(0)
    if node.nodeName() != "LogicalRelation":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < parts < cores else df
