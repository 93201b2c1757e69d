"""Index tables: chunk metadata, postings and their statistics, upserts, deletes, manifest.

One table of chunks is the source; postings and vectors are derived from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.folders import kept
from millrace.functions.spread import spread
from millrace.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def chunk_metadata(chunks: DataFrame, department: str = "general", access_level: str = "internal", doc_version: str = "v1", more: Sequence[str] = ()) -> DataFrame:
    """The flat metadata of chunks, and more of their columns; a missing label is an empty string."""
    return chunks.select(
        "chunk_id", "file_hash", "filename", "source_path", "page", F.coalesce("article_label", F.lit("")).alias("article_label"), "kind", "language_hint",
        F.lit(department).alias("department"), F.lit(access_level).alias("access_level"), F.lit(doc_version).alias("doc_version"), *more,
    )


def token_table(chunks: DataFrame, key: str, text: str) -> DataFrame:
    rows = spread(chunks.select(F.col(key).alias("key"), F.col(text).alias("_text")))
    return rows.select("key", tokens(F.coalesce(F.col("_text"), F.lit(""))).alias("tokens"))


def exploded(terms: Column) -> Column:
    """One row per term, and a null for none: an inner explode would test for none by tokenising twice."""
    return F.explode_outer(terms).alias("term")


def doc_lengths(table: DataFrame) -> DataFrame:
    return table.select("key", F.size("tokens").cast("long").alias("dl"))


def postings(table: DataFrame) -> DataFrame:
    """(term, key, tf); summed before the shuffle."""
    return table.select("key", exploded(F.col("tokens"))).where("term is not null").groupBy("term", "key").agg(F.count("*").alias("tf"))


def corpus_stats(table: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length."""
    return table.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def term_stats(table: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) of a token_table; a negative idf becomes a quarter of the mean over all terms."""
    stats = corpus_stats(table) if stats is None else stats
    df = table.select(exploded(F.array_distinct("tokens"))).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("raw"))  # stats is one row
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class TermCounts:
    """counts (term, df), written; number of chunks, mean length, and the mean of idf over all terms."""

    counts: DataFrame
    n: int
    avgdl: float
    mean: float


def term_counts(table: DataFrame) -> TermCounts:
    """One pass over the token_table; counts are summed before the shuffle and written, since they are read several times."""
    held = table.select(F.size("tokens").alias("dl"), exploded(F.concat(F.array_distinct("tokens"), F.array(F.lit("")))))
    # The empty word stands for every chunk.
    counts = kept(held.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")), "terms")
    whole = counts.where("term = ''").select("df", "dl").first()
    n, words = (whole["df"], whole["dl"]) if whole else (0, 0)
    counts = counts.where("term <> ''").select("term", "df")
    mean = counts.agg(F.avg(idf(F.lit(n), F.col("df"))).alias("mean")).first()["mean"] or 0.0
    return TermCounts(counts, n, words / n if n else 0.0, mean)


def known_terms(counts: TermCounts, asked: DataFrame) -> DataFrame:
    """(term, df, idf) of the asked words that the table has; asked is a batch's."""
    own = counts.counts.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    raw = idf(F.lit(counts.n), F.col("df"))
    return own.select("term", "df", F.when(raw < 0, EPSILON * counts.mean).otherwise(raw).alias("idf"))


def asked_terms(table: DataFrame, asked: DataFrame) -> tuple[DataFrame, float]:
    """asked (query_id, term, qf) with idf, and the chunks' mean length; one pass over the token_table."""
    counts = term_counts(table)
    return asked.join(F.broadcast(known_terms(counts, asked).drop("df")), "term"), counts.avgdl


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("chunk_id",), order: str | None = None) -> DataFrame:
    """old with new's rows over those of equal keys; within new, the last by ``order`` wins."""
    if order is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
        new = new.withColumn("_n", rank).where("_n = 1").drop("_n")
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def delete_where(table: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and a one-row table of how many go."""
    keys = gone.select(key).distinct()
    return table.join(keys, key, "left_anti"), table.join(keys, key, "left_semi").agg(F.count("*").alias("deleted"))


def classify(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per path its status against the manifest: new, unchanged, changed or deleted."""
    now, old = scan.select("source_path", F.col("file_hash").alias("new_hash")), manifest.select("source_path", F.col("file_hash").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    )
    return now.join(old, "source_path", "full_outer").select("source_path", "new_hash", "old_hash", status.alias("status"))


def apply_changes(chunks: DataFrame, changes: DataFrame, added: DataFrame) -> DataFrame:
    """The chunk table after a run; deletes go by path and hash, so twins of a file stay."""
    gone = changes.where("status in ('changed', 'deleted')").select("source_path", F.col("old_hash").alias("file_hash"))
    return chunks.join(gone, ["source_path", "file_hash"], "left_anti").unionByName(added)


def next_manifest(scan: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_path, file_hash, chunk_count; files without chunks are kept with 0."""
    counts = chunks.groupBy("source_path", "file_hash").agg(F.count("*").cast("int").alias("chunk_count"))
    return scan.select("source_path", "file_hash").join(counts, ["source_path", "file_hash"], "left").na.fill(0, ["chunk_count"])


def run_summary(changes: DataFrame) -> DataFrame:
    """One row: files seen, added, skipped and deleted."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.agg(of("new", "changed", "unchanged").alias("total"), of("new", "changed").alias("added"), of("unchanged").alias("skipped"), of("deleted").alias("deleted"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
