"""The audit trail: append-only rows without passage texts; flags are later rows of the same event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sources(relevant: Column) -> Column:
    """Passages cut down to what the trail keeps."""
    return F.transform(relevant, lambda s: F.struct(*[s[c].alias(c) for c in ("filename", "page", "article_label", "chunk_id", "doc_version")]))


def audit_rows(answers: DataFrame, flagged: Column | None = None) -> DataFrame:
    """answers: department, clearance, query, answer, relevant, trace."""
    flag = F.lit(False) if flagged is None else flagged
    return answers.select(F.current_timestamp().alias("timestamp"), "department", "clearance", "query", "answer", sources(F.col("relevant")).alias("sources"), "trace", flag.alias("flagged"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_flags(rows: DataFrame, *event: str) -> DataFrame:
    """One row per event, flagged if any of its rows is."""
    return rows.groupBy(*event).agg(F.max("flagged").alias("flagged"), F.count("*").alias("n_rows"))
