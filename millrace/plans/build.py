"""End to end: build or update an index from a folder, search it, answer from it.

The index is a log. Each run appends one version: the chunks and vectors that it
adds, the (path, hash) pairs that it removes, and last the manifest rows, which
commit the version. What a run writes follows what changed, not the size of the
index, and so it is with the version's lexical segment. Readers take versions up
to the last committed one, and leave out chunks that a later version removes.
Chunks, vectors and postings lie in folders by department and access level, so a
search opens what its readers may read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Config
from millrace.operators import access, agent, chunk, index, retrieve, segments
from millrace.sources import files

_CHUNK = "chunk_id string, file_hash string, filename string, source_path string, page int, article_label string, kind string, language_hint string, doc_version string, content string, token_estimate int, version int, department string, access_level string"
_TABLES = {
    "manifest": "source_path string, file_hash string, chunk_count int, length long, modified long, version int",
    "chunks": _CHUNK,
    "vectors": "source_path string, chunk_id string, file_hash string, v array<float>, version int, department string, access_level string",
    "gone": "source_path string, file_hash string, version int",
}


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def _log(spark: SparkSession, index_dir: str, name: str) -> DataFrame:
    """All rows of a table's versions; empty before the first run."""
    path = f"{index_dir}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], _TABLES[name])
    return spark.read.schema(_TABLES[name]).parquet(path)


def last_version(spark: SparkSession, index_dir: str) -> int:
    return _log(spark, index_dir, "manifest").agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def manifest(spark: SparkSession, index_dir: str, upto: int | None = None) -> DataFrame:
    """source_path, file_hash, chunk_count, length, modified of the files that are indexed now, or were at a version."""
    rows = _log(spark, index_dir, "manifest")
    rows = (rows if upto is None else rows.where(F.col("version") <= upto)).groupBy("source_path").agg(F.max_by(F.struct("file_hash", "chunk_count", "length", "modified"), "version").alias("m"))
    return rows.select("source_path", "m.*").where("file_hash is not null")


def _current(spark: SparkSession, index_dir: str, name: str, upto: int | None = None) -> DataFrame:
    upto = last_version(spark, index_dir) if upto is None else upto
    rows = _log(spark, index_dir, name).where(F.col("version") <= upto)
    gone = _log(spark, index_dir, "gone").where(F.col("version") <= upto).groupBy("source_path", "file_hash").agg(F.max("version").alias("_gone"))
    return rows.join(gone, ["source_path", "file_hash"], "left").where("_gone is null or _gone <= version").drop("_gone", "version")


def chunks(spark: SparkSession, index_dir: str) -> DataFrame:
    return _current(spark, index_dir, "chunks")


def vectors(spark: SparkSession, index_dir: str) -> DataFrame:
    return _current(spark, index_dir, "vectors")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _lexical(index_dir: str) -> str:
    return f"{index_dir}/lexical"


def _keyed(table: DataFrame) -> DataFrame:
    """table with key, which is path and chunk id."""
    return table.select(F.concat_ws("#", "source_path", "chunk_id").alias("key"), "*")


def stats(spark: SparkSession, index_dir: str) -> DataFrame:
    """One row: files, chunks and vectors."""
    of = lambda df, name: df.agg(F.count("*").alias(name))
    return of(manifest(spark, index_dir), "files").join(of(chunks(spark, index_dir), "chunks")).join(of(vectors(spark, index_dir), "vectors"))


def build_index(spark: SparkSession, raw_dir: str, index_dir: str, department: str = "general", access_level: str = "internal", doc_version: str = "v1", rebuild: bool = False, config: Config | None = None, embedder=None) -> DataFrame:
    """Brings the index up to the folder's state; a one-row summary.

    Files of the path, length and time that the index has are not opened. Of the
    others hashes decide before anything is parsed: only new and changed files are.
    rebuild reads all, and treats every file as changed. A file's department is its first
    folder below raw_dir, or the given one. Unreadable files are left as they
    were and counted as failed.
    """
    version = last_version(spark, index_dir) + 1
    files.listing(spark, raw_dir).write.mode("overwrite").parquet(f"{index_dir}/listing/version={version}")
    listed, known = spark.read.parquet(f"{index_dir}/listing/version={version}"), manifest(spark, index_dir)
    same = known.where("false" if rebuild else "true").join(listed, ["source_path", "length", "modified"], "left_semi")
    scan = files.read(listed.join(same, "source_path", "left_anti"), raw_dir)
    changes = index.classify(scan.select("source_path", "file_hash").unionByName(same.select("source_path", "file_hash")), known)
    if rebuild:
        changes = changes.withColumn("status", F.when(F.col("status") == "unchanged", "changed").otherwise(F.col("status")))
    return write_version(spark, raw_dir, index_dir, version, scan, changes, department, access_level, doc_version, config, embedder, listed)


def write_version(spark: SparkSession, raw_dir: str, index_dir: str, version: int, scan: DataFrame, changes: DataFrame, department: str = "general", access_level: str = "internal", doc_version: str = "v1", config: Config | None = None, embedder=None, listed: DataFrame | None = None) -> DataFrame:
    """Writes one version over what may be there of it: the same call twice leaves one version.

    scan: source_path, content, file_hash of the files in question. changes: what
    index.classify says of them against the versions before, deletions included.
    listed: source_path, length, modified, by which a later run knows files that need no look.
    """
    config = config or Config()
    changes.write.mode("overwrite").parquet(f"{index_dir}/changes/version={version}")
    changes = spark.read.parquet(f"{index_dir}/changes/version={version}")
    todo = changes.where("status in ('new', 'changed')").select("source_path")
    parsed = files.load(scan.join(todo, "source_path", "left_semi"))
    _write(parsed, f"{index_dir}/documents/version={version}")
    parsed = spark.read.parquet(f"{index_dir}/documents/version={version}")
    good = parsed.where("error is null")
    made = chunk.chunk_blocks(files.blocks_of(good), config.chunking)
    rows = index.chunk_metadata(made, department, access_level, doc_version, ["content", "token_estimate"])
    rows = rows.withColumn("department", access.department_of(files.relative(F.col("source_path"), raw_dir), department))
    _write(rows, f"{index_dir}/chunks/version={version}", "department", "access_level")
    rows = spark.read.schema(_CHUNK).parquet(f"{index_dir}/chunks").where(F.col("version") == version)
    embed = embedder or retrieve.hash_embedder()
    vectors_ = rows.select("source_path", "chunk_id", "file_hash", embed("content").alias("v"), "department", "access_level")
    _write(vectors_, f"{index_dir}/vectors/version={version}", "department", "access_level")
    # A removal reaches the chunks of earlier versions; those written by this run stay.
    removed = changes.where("status = 'deleted'").unionByName(changes.where("status = 'changed'").join(good.select("source_path"), "source_path", "left_semi"))
    removed.select("source_path", F.col("old_hash").alias("file_hash")).write.mode("overwrite").parquet(f"{index_dir}/gone/version={version}")
    # Chunks that end here, as the last version has them.
    ended = _current(spark, index_dir, "chunks", version - 1).join(spark.read.parquet(f"{index_dir}/gone/version={version}"), ["source_path", "file_hash"], "left_semi")
    as_rows = lambda df: _keyed(df).select("key", "department", "access_level", F.col("content").alias("text"))
    segments.append(spark, _lexical(index_dir), version, as_rows(rows), as_rows(ended))
    stat = listed if listed is not None else changes.select("source_path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("modified"))
    count = index.next_manifest(good.select("source_path", "file_hash"), rows)
    # Files of the same bytes and another time are noted, so that they aren't read for it again.
    was = manifest(spark, index_dir, version - 1)
    touched = was.join(changes.where("status = 'unchanged'"), "source_path", "left_semi").select("source_path", "file_hash", "chunk_count", "length", "modified")
    touched = touched.join(listed, ["source_path", "length", "modified"], "left_anti") if listed is not None else touched.where("false")
    dropped = changes.where("status = 'deleted'").select("source_path", F.lit(None).cast("string").alias("file_hash"), F.lit(0).alias("chunk_count"))
    noted = count.unionByName(touched.select("source_path", "file_hash", "chunk_count")).unionByName(dropped).join(stat, "source_path", "left")
    noted.write.mode("overwrite").parquet(f"{index_dir}/manifest/version={version}")
    failed = parsed.agg(F.count_if(F.col("error").isNotNull()).alias("failed"))
    return index.run_summary(changes).join(failed)


def search(spark: SparkSession, index_dir: str, queries: DataFrame, config: Config | None = None, embedder=None) -> DataFrame:
    """(query_id, key, score, rank, fusion, passage) of each query (query_id, query, department, clearance).

    key is path and chunk id. Lexical statistics are of the whole index; folders
    that no reader of the batch may open are not read, and a query meets the rows
    of its own reader's folders only.
    """
    config, embed = config or Config(), embedder or retrieve.hash_embedder()
    upto = last_version(spark, index_dir)
    lexical = segments.Search(spark, _lexical(index_dir), queries, config.retrieval.top_k_bm25, upto).filled()
    folders = segments.open_to(queries)
    own = segments.only(_keyed(_current(spark, index_dir, "vectors", upto)), folders).select("key", "v", "department", "access_level")
    asked = queries.select("query_id", embed("query").alias("q")).join(folders, "query_id")
    vector = retrieve.vector_topk(own, asked, config.retrieval.top_k_vector, on=["department", "access_level"])
    fused = retrieve.rrf(vector, lexical, config.retrieval.rrf_k, config.retrieval.top_k_after_fusion)
    table = segments.only(_keyed(_current(spark, index_dir, "chunks", upto)), folders)
    return table.join(F.broadcast(fused), "key").join(queries.select("query_id", "query"), "query_id")


def passages(spark: SparkSession, index_dir: str, queries: DataFrame, config: Config | None = None) -> DataFrame:
    """(query_id, passages): reranked hits as the answer loop takes them."""
    config = config or Config()
    best = retrieve.rerank(search(spark, index_dir, queries, config), k=config.retrieval.top_k_after_rerank)
    one = F.struct("chunk_id", "content", "filename", "page", "article_label", "doc_version", "score")
    return best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("p")))), lambda x: x["p"]).alias("passages"))


def answer(spark: SparkSession, index_dir: str, queries: DataFrame, config: Config | None = None, models: agent.Models | None = None) -> DataFrame:
    """Final states of a batch of questions against the index."""
    config = config or Config()
    return agent.answer_batch(queries, lambda q: passages(spark, index_dir, q, config), models, config.agent)
