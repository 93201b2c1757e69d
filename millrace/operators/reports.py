"""Reports over chunks and labels."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.folders import kept


def size_report(rows: DataFrame, by: list[str], size: Column, kind: str | None = None, tokens: Column | None = None, label: str | None = None) -> DataFrame:
    """Per group: counts, least, mean (rounded down) and greatest size, and three size classes."""
    n = size.cast("long")
    out = [
        F.count("*").alias("n"),
        F.min(n).alias("min_size"),
        F.floor(F.sum(n) / F.count("*")).cast("long").alias("avg_size"),
        F.max(n).alias("max_size"),
        F.count_if(n < 100).alias("tiny"),
        F.count_if((n >= 100) & (n < 300)).alias("small"),
        F.count_if(n >= 300).alias("full"),
    ]
    if tokens is not None:
        out.append(F.sum(tokens).cast("long").alias("tokens"))
    if kind is not None:
        out += [F.count_if(F.col(kind) == "text").alias("n_text"), F.count_if(F.col(kind) == "table").alias("n_table")]
    if label is not None:
        out += [F.count_if(F.col(label).isNotNull()).alias("labelled"), F.count_if(F.coalesce(F.col(label), F.lit("")) != "").alias("named")]
    return rows.groupBy(*by).agg(*out)


def count_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def top_labels(rows: DataFrame, label: str, order: str, n: int = 15) -> DataFrame:
    """The n most common labels; ties go to the one seen first."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.col("n").desc(), "first_seen").limit(n)


def stride_sample(rows: DataFrame, by: str, order: list[str], n: int = 10) -> DataFrame:
    """Every m-th row of each group, m its size over n (at least 1), at most n rows."""
    w = Window.partitionBy(by)
    numbered = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / n)))
    return numbered.where(f"_r % _m = 0 and _r div _m < {n}").drop("_r", "_m")


def departments(rows: DataFrame, column: str = "department") -> DataFrame:
    """Distinct departments in order; the general one where there are none."""
    found = rows.select(F.col(column).alias("department")).where("department is not null").distinct()
    gathered = found.agg(F.sort_array(F.collect_set("department")).alias("d"))  # departments are a short list
    return gathered.select(F.explode(F.when(F.size("d") == 0, F.array(F.lit("general"))).otherwise(F.col("d"))).alias("department"))


def staged(stages: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], k: int = 5) -> DataFrame:
    """The first k rows a query of each retrieval stage (query_id, key, score, rank), with stage, its place and its seconds.

    A stage is a function of the stages before it; each is run and written in
    turn, so its seconds are its own.
    """
    done: dict[str, DataFrame] = {}
    out: DataFrame | None = None
    for place, (name, make) in enumerate(stages.items()):
        began = time.monotonic()
        done[name] = kept(make(done), f"stage-{name}")
        took = time.monotonic() - began
        rows = done[name].where(F.col("rank") <= k).select(F.lit(place).alias("place"), F.lit(name).alias("stage"), "query_id", F.col("rank").cast("int").alias("rank"), "key", F.col("score").cast("double").alias("score"), F.lit(took).alias("seconds"))
        out = rows if out is None else out.unionByName(rows)
    return out


def block_report(blocks: DataFrame, *by: str) -> DataFrame:
    """Per document its blocks: how many, of text and of tables, their characters, the longest, and the last page (1 for none)."""
    size = F.length("content").cast("long")
    return blocks.groupBy(*by).agg(
        F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "text").alias("n_text"), F.count_if(F.col("kind") == "table").alias("n_table"),
        F.sum(size).alias("chars"), F.max(size).alias("longest"), F.coalesce(F.max("page"), F.lit(1)).cast("int").alias("pages"),
    )


def trace_report(states: DataFrame) -> DataFrame:
    """One row a step of each final state: its note, and on every row how the question ended."""
    rows = states.select("query_id", "final_reason", "steps", "rewrite_count", "generation_count", F.size("relevant").alias("n_relevant"), F.posexplode_outer("notes").alias("step", "note"))
    return rows.withColumn("node", F.regexp_extract("note", "^([a-z_]+):", 1))
