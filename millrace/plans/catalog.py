"""Registered queries over the driver's tables, each with its DuckDB twin.

A document row stands for a chunk: its id is the key, its source the department,
and the id modulo 3 gives an access level. Cyrillic, headings and tables, which
the tables lack, are made from them inside the queries, alike on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.config import Agent
from millrace.functions import tables, text
from millrace.functions.folders import kept, shared_folder
from millrace.functions.spread import spread
from millrace.operators import access, agent, audit, buckets, chunk, index, models, reports, retrieve, segments, vector_index
from millrace.plans import build
from millrace.plans import sql as S
from millrace.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents, for queries whose time goes into their texts."""
    return spread(_t(spark, d, "documents"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "internal").otherwise("confidential")
    return _t(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "lang", F.col("source").alias("department"), level.alias("access_level"))


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.ASKED, "query_id int, query string")


def _passages_asked(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text as a query, with all its words."""
    return _t(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("query_id"), F.col("text").alias("query"))


def _int(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


# Lexical index and search ------------------------------------------------------


@query(f"SELECT doc_id AS key, len({S.tok('text')})::INT AS n_tokens, len(list_distinct({S.tok('text')}))::INT AS n_distinct FROM documents")
def tokenize_stats(spark, d):
    table = index.token_table(_docs(spark, d), "key", "text")
    return table.select("key", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


@query(f"WITH {S.BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark, d):
    table = index.token_table(_docs(spark, d), "key", "text")
    return index.term_stats(table).withColumn("idf", F.round("idf", 6))


@query(f"WITH {S.BM25} SELECT key, dl FROM dl")
def bm25_doc_len(spark, d):
    return index.doc_lengths(index.token_table(_docs(spark, d), "key", "text"))


@query(f"WITH {S.BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def bm25_corpus_stats(spark, d):
    return index.corpus_stats(index.token_table(_docs(spark, d), "key", "text")).withColumn("avgdl", F.round("avgdl", 6))


@query(S.bm25_top(S.asked(1), 10))
def bm25_topk(spark, d):
    table = index.token_table(_docs(spark, d), "key", "text")
    return retrieve.bm25_topk(table, _asked(spark).where("query_id = 1"), 10)


@query(S.bm25_top(S.asked(2, 3, 4), 10))
def bm25_topk_zero_fill(spark, d):
    table = index.token_table(_docs(spark, d), "key", "text")
    return retrieve.bm25_topk(table, _asked(spark).where("query_id > 1"), 10)


@query(S.bm25_top(S.asked(1, 2), 10, "department IN ('src1', 'general') AND access_level IN ('public', 'internal')"))
def bm25_topk_filtered(spark, d):
    docs, asked = _docs(spark, d), _asked(spark).where("query_id < 3")
    allowed = docs.where(access.where_column(access.access_filter("src1", "internal"))).select("key").join(F.broadcast(asked.select("query_id")))
    return retrieve.bm25_topk(index.token_table(docs, "key", "text"), asked, 10, allowed=allowed)


@query(S.bm25_top(S.PASSAGES, 5))
def bm25_batch(spark, d):
    return retrieve.bm25_topk_long(index.token_table(_docs(spark, d), "key", "text"), _passages_asked(spark, d), 5)


def _segment(docs: DataFrame) -> DataFrame:
    return docs.select("key", "department", "access_level", "text")


@query(S.bm25_top(S.asked(1, 2, 3, 4), 10))
def bm25_stored(spark, d):
    path = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    segments.append(spark, path, 1, _segment(_docs(spark, d)))
    return segments.Search(spark, path, _asked(spark), 10, 1).filled()


@query(S.SEGMENTS)
def lexical_segments(spark, d):
    # All documents but some, then a version that adds, changes and removes; read as segments, and as one.
    path, docs = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}", _segment(_docs(spark, d))
    last = F.pmod(F.col("key"), F.lit(10))
    segments.append(spark, path, 1, docs.where(last != 3))
    changed = docs.where(last.isin(3, 5)).withColumn("text", F.when(last == 5, F.concat("text", F.lit(" thereon thereon"))).otherwise(F.col("text")))
    segments.append(spark, path, 2, changed, docs.where(last.isin(5, 7)))
    segments.compact(spark, path, f"{path}-one", 2)
    found = [segments.Search(spark, p, _asked(spark), 10, v).filled().withColumn("form", F.lit(form)) for p, v, form in ((path, 2, "segments"), (f"{path}-one", 1, "compacted"))]
    return found[0].unionByName(found[1])


@query(S.ACCESS_TOP)
def access_stored(spark, d):
    path, docs = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}", _docs(spark, d)
    segments.append(spark, path, 1, _segment(docs))
    hits = segments.Search(spark, path, _readers(spark), 3, 1).filled()
    return docs.join(F.broadcast(hits), "key").select("query_id", "key", "score", "rank", "department")


def _readers(spark) -> DataFrame:
    """Three queries of three readers."""
    readers = spark.createDataFrame([(i, dep, "internal") for i, dep in enumerate(S.READERS)], "reader int, department string, clearance string")
    asked = _asked(spark).where("query_id < 4").join(F.broadcast(readers))
    return asked.select((F.col("query_id") * 10 + F.col("reader")).alias("query_id"), "query", "department", "clearance")


# Vector search, fusion, reranking ----------------------------------------------


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), "label")


def _probe(vectors: DataFrame, which: Column) -> DataFrame:
    return vectors.where(which).select(F.col("key").cast("int").alias("query_id"), F.col("v").alias("q"))


@query(S.vector_top("vec_id = 0", 20))
def vector_topk(spark, d):
    v = _vectors(spark, d)
    return retrieve.vector_topk(v, _probe(v, F.col("key") == 0), 20)


@query(S.vector_top("vec_id = 0", 20, "label IN (1, 2)"))
def vector_topk_filtered(spark, d):
    v = _vectors(spark, d)
    return retrieve.vector_topk(v, _probe(v, F.col("key") == 0), 20, access.where_column({"label": {"$in": [1, 2]}}))


@query(S.vector_top("vec_id % 100 = 0", 20))
def vector_batch(spark, d):
    v = _vectors(spark, d)
    return retrieve.vector_topk(v, _probe(v, F.col("key") % 100 == 0), 20)


def _indexed(spark, d, allowed: Column | None = None) -> DataFrame:
    path, v = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", _vectors(spark, d)
    vector_index.write(v, path, list_rows=50)
    return vector_index.Search(spark, path, _probe(v, F.col("key") % 100 == 0), 20, allowed).hits()


@query(S.vector_top("vec_id % 100 = 0", 20))
def vector_indexed(spark, d):
    return _indexed(spark, d)


@query(S.vector_top("vec_id % 100 = 0", 20, "label IN (1, 2)"))
def vector_indexed_filtered(spark, d):
    return _indexed(spark, d, access.where_column({"label": {"$in": [1, 2]}}))


def _legs(spark, d):
    v = _vectors(spark, d)
    vec = retrieve.vector_topk(v, _probe(v, F.col("key") == 0).withColumn("query_id", F.lit(1)), 20)
    lex = retrieve.bm25_topk(index.token_table(_docs(spark, d), "key", "text"), _asked(spark).where("query_id = 1"), 20)
    return vec, lex


@query(f"WITH {S.LEGS} SELECT query_id, key, score, rank::INT AS rank FROM fused WHERE rank <= 10")
def rrf_fusion(spark, d):
    return retrieve.rrf(*_legs(spark, d)).select("query_id", "key", "score", "rank")


@query(f"WITH {S.LEGS} SELECT f.query_id, f.key, source, l.rank::INT AS rank, l.score FROM fused f JOIN legs l ON l.key = f.key WHERE f.rank <= 10")
def rrf_provenance(spark, d):
    return retrieve.rrf(*_legs(spark, d)).select("query_id", "key", F.explode("fusion").alias("f")).select("query_id", "key", "f.source", "f.rank", "f.score")


@query(f"WITH {S.LEGS} SELECT f.query_id, f.key, f.score, f.rank::INT AS rank, d.source AS department, length(d.text)::INT AS n FROM fused f JOIN documents d ON d.doc_id = f.key WHERE f.rank <= 10")
def hybrid_search(spark, d):
    hits = retrieve.rrf(*_legs(spark, d))
    return _docs(spark, d).join(F.broadcast(hits), "key").select("query_id", "key", "score", "rank", "department", F.length("text").alias("n"))


def _hits(spark, d):
    hits = retrieve.rrf(*_legs(spark, d)).join(_asked(spark), "query_id")
    return _docs(spark, d).select("key", F.col("text").alias("content")).join(F.broadcast(hits), "key")


@query(f"WITH {S.RERANK} SELECT query_id, key, score, rank::INT AS rank, hybrid_score FROM reranked WHERE rank <= 5")
def rerank_topk(spark, d):
    return retrieve.rerank(_hits(spark, d)).select("query_id", "key", "score", "rank", "hybrid_score")


@query(f"WITH {S.RERANK} SELECT query_id + n AS query_id, key, score, rank::INT AS rank FROM reranked, (SELECT unnest([0, 10])::INT AS n) WHERE rank <= 5")
def rerank_cached(spark, d):
    hits = _hits(spark, d)
    shouted = hits.withColumn("query_id", F.col("query_id") + 10).withColumn("query", F.concat(F.lit(" "), F.upper("query")))
    return retrieve.rerank(hits.unionByName(shouted)).select("query_id", "key", "score", "rank")


@query(f"WITH {S.RERANK} SELECT query_id + n AS query_id, key, score, rank::INT AS rank FROM reranked, (SELECT unnest([0, 10])::INT AS n) WHERE rank <= 5")
def rerank_stored(spark, d):
    # The second call finds its pairs' scores where the first one left them; a scorer that gives null shows it.
    hits, path = kept(_hits(spark, d), "hits"), f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    retrieve.rerank_stored(hits, path)
    shouted = hits.withColumn("query_id", F.col("query_id") + 10).withColumn("query", F.concat(F.lit(" "), F.upper("query")))
    again = retrieve.rerank_stored(hits.unionByName(shouted), path, scorer=lambda q, c: F.lit(None).cast("double"))
    return again.select("query_id", "key", "score", "rank")


@query(S.CACHED)
def score_cache(spark, d):
    # Two calls with other documents, and the pairs that are left of 300 at most, with 75 going out at a time.
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    asked = _asked(spark).where("query_id = 1")
    hits = _docs(spark, d).select("key", F.col("text").alias("content"), F.col("key").alias("rank"), F.lit(0.0).alias("score")).join(F.broadcast(asked))
    for part in (F.col("key") % 3 == 0, F.col("key") % 3 != 0):
        retrieve.rerank_stored(hits.where(part), path, most=300, drop=75)
    return retrieve.cached_scores(spark, path).select("query", "key", "score", "seq")


@query(S.STAGES)
def retrieval_report(spark, d):
    v, asked = _vectors(spark, d), _asked(spark).where("query_id = 1")
    table, docs = index.token_table(_docs(spark, d), "key", "text"), _docs(spark, d).select("key", F.col("text").alias("content"))
    stages = {
        "vector": lambda _: retrieve.vector_topk(v, _probe(v, F.col("key") == 0).withColumn("query_id", F.lit(1)), 20),
        "bm25": lambda _: retrieve.bm25_topk(table, asked, 20),
        "hybrid": lambda done: retrieve.rrf(done["vector"], done["bm25"]),
        "reranked": lambda done: retrieve.rerank(docs.join(F.broadcast(done["hybrid"].join(asked, "query_id")), "key")),
    }
    return reports.staged(stages).drop("seconds")


@query(S.ACCESS_TOP)
def access_matrix_top(spark, d):
    docs, asked = _docs(spark, d), _readers(spark)
    allowed = access.readable_pairs(asked.select("query_id", "department", "clearance"), docs.select("key", "department", "access_level")).select("query_id", "key")
    hits = retrieve.bm25_topk(index.token_table(docs, "key", "text"), asked, 3, allowed=allowed)
    return docs.join(F.broadcast(hits), "key").select("query_id", "key", "score", "rank", "department")


@query(S.PROMPTED)
def prompt_grade(spark, d):
    rows = _t(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.sha2(models.prompt("relevant", query=F.col("text"), passage=F.concat(F.col("text"), F.lit(" {query}"))), 256).alias("sha"))


def _queries(spark, d) -> DataFrame:
    """The texts of the documents that share their ids with vector_batch's queries."""
    ids = _vectors(spark, d).where("key % 100 = 0").select("key")
    return _docs(spark, d).join(ids, "key", "left_semi").select(F.col("key").cast("int").alias("query_id"), F.col("text").alias("query"))


def _fused(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    lex = retrieve.bm25_topk_long(index.token_table(_docs(spark, d), "key", "text"), _queries(spark, d), 20)
    return retrieve.rrf(retrieve.vector_topk(v, _probe(v, F.col("key") % 100 == 0), 20), lex)


@query(f"WITH {S.LEGS_BATCH} SELECT f.query_id, f.key, f.score, f.rank::INT AS rank, source, l.rank::INT AS leg_rank, l.score AS leg_score FROM fused f JOIN legs l ON l.query_id = f.query_id AND l.key = f.key WHERE f.rank <= 10")
def rrf_batch(spark, d):
    return _fused(spark, d).select("query_id", "key", "score", "rank", F.explode("fusion").alias("f")).select("query_id", "key", "score", "rank", "f.source", F.col("f.rank").alias("leg_rank"), F.col("f.score").alias("leg_score"))


@query(f"WITH {S.RERANK_BATCH} SELECT query_id + n AS query_id, key, score, rank::INT AS rank, hybrid_score FROM reranked, (SELECT unnest([0, 50])::INT AS n) WHERE rank <= 5")
def rerank_batch(spark, d):
    asked = _queries(spark, d).where(F.size(retrieve.tokens(F.col("query"))) > 0)
    hits = _docs(spark, d).select("key", F.col("text").alias("content")).join(kept(_fused(spark, d), "fused").join(asked, "query_id"), "key")
    spaced = hits.withColumn("query_id", F.col("query_id") + 50).withColumn("query", F.concat(F.lit(" "), "query"))
    return retrieve.rerank(hits.unionByName(spaced)).select("query_id", "key", "score", "rank", "hybrid_score")


# Access ------------------------------------------------------------------------


@query(f"SELECT key, department, access_level FROM ({S.DOCS}) WHERE department IN ('src3', 'general') AND access_level IN ('public', 'internal')")
def access_filter(spark, d):
    return _docs(spark, d).where(access.where_column(access.access_filter("src3", "internal"))).select("key", "department", "access_level")


@query(f"SELECT key, access_level FROM ({S.DOCS}) WHERE department IN ('src3', 'general') AND access_level = 'public'")
def clearance_unknown(spark, d):
    return _docs(spark, d).where(access.where_column(access.access_filter("src3", "cosmic"))).select("key", "access_level")


@query(f"SELECT key FROM ({S.DOCS}) WHERE lang = 'en' AND department IN ('src1', 'src2')")
def where_eq_in_and(spark, d):
    return _docs(spark, d).where(access.where_column({"$and": [{"lang": "en"}, {"department": {"$in": ["src1", "src2"]}}], "lang": "ignored"})).select("key")


@query(f"""
SELECT reader, k.department AS row_department, access_level, count(*) AS n
FROM (VALUES (1, 'src1', 'public'), (2, 'src1', 'internal'), (3, 'src2', 'confidential'), (4, 'general', 'odd')) AS r(reader, department, clearance)
JOIN ({S.DOCS}) k ON k.department IN (r.department, 'general')
 AND (CASE access_level WHEN 'public' THEN 0 WHEN 'internal' THEN 1 ELSE 2 END) <= (CASE clearance WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 ELSE 0 END)
GROUP BY ALL""")
def access_matrix(spark, d):
    readers = spark.createDataFrame([(1, "src1", "public"), (2, "src1", "internal"), (3, "src2", "confidential"), (4, "general", "odd")], "reader int, department string, clearance string")
    rows = access.readable_pairs(readers, _docs(spark, d).select("key", "department", "access_level"))
    return rows.groupBy("reader", "row_department", "access_level").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN len(p) > 1 THEN p[1] ELSE 'general' END AS department FROM (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/') AS p FROM pages)")
def department_from_path(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    return _t(spark, d, "pages").select("page_id", access.department_of(path, "general").alias("department"))


@query(r"SELECT page_id, ext, ext IN ('.pdf', '.docx', '.txt') AS supported FROM (SELECT page_id, lower(regexp_extract(path, '\.[^./]*$', 0)) AS ext FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || (CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '' END) AS path FROM pages))")
def extension_router(spark, d):
    more = F.when(F.col("page_id") % 4 == 0, ".PDF").when(F.col("page_id") % 4 == 1, ".txt").otherwise("")
    ext = files.extension(F.concat(F.regexp_replace("url", "[?#].*$", ""), more))
    return _t(spark, d, "pages").select("page_id", ext.alias("ext"), ext.isin(*files.EXTENSIONS).alias("supported"))


# Text --------------------------------------------------------------------------


def _dirty(col: Column) -> Column:
    spaced = F.replace(F.replace(col, F.lit(". "), F.lit(".\u200b  \t")), F.lit("e\n"), F.lit("e-\n "))
    return F.concat(F.lit("\ufeff "), spaced, F.lit("\n\n\n\n\ne\u0301  "))


def _cyr(col: Column) -> Column:
    return F.translate(F.lower(col), *S.CYR)


def _only_cyr(col: Column) -> Column:
    return F.regexp_replace(_cyr(col), "[A-z]", "")


@query(f"SELECT doc_id, sha256({S.clean(S.dirty('text'))}) AS sha, length({S.clean(S.dirty('text'))})::INT AS n FROM documents")
def clean_whitespace(spark, d):
    return _texts(spark, d).select("doc_id", text.clean_whitespace(_dirty(F.col("text"))).alias("c")).select("doc_id", F.sha2("c", 256).alias("sha"), F.length("c").alias("n"))


@query(f"SELECT doc_id, {S.script('text')} AS raw, {S.script(S.cyr('text'))} AS mixed, {S.script(S.only_cyr('text'))} AS cyrillic, {S.script(S.russian('text'))} AS russian FROM documents")
def script_detect(spark, d):
    t = F.col("text")
    shown = {"raw": t, "mixed": _cyr(t), "cyrillic": _only_cyr(t), "russian": F.replace(_only_cyr(t), F.lit("о"), F.lit("ы"))}
    return _texts(spark, d).select("doc_id", *[text.detect_script(v).alias(k) for k, v in shown.items()])


@query(f"SELECT doc_id, sha256({S.latin(S.letters('text'))}) AS sha FROM documents")
def translit(spark, d):
    both = F.concat(_cyr(F.col("text")), F.translate(_cyr(F.col("text")), S.CYR[1], S.CYR[1].upper()), F.lit("ШшЧчЮюЯяЁёЎўҒғҲҳҚқЪъЫыЭэЬьЩщ"))
    return _texts(spark, d).select("doc_id", F.sha2(text.to_latin(both), 256).alias("sha"))


@query(f"""
SELECT doc_id, CASE WHEN hint = 'uz-cyrl' THEN 'uz-latn' ELSE hint END AS hint, sha256(CASE WHEN hint = 'uz-cyrl' THEN {S.latin('c')} ELSE c END) AS sha
FROM (SELECT doc_id, c, {S.script('c')} AS hint FROM (SELECT doc_id, {S.clean(S.dirty_cyr('text'))} AS c FROM documents))""")
def normalize_full(spark, d):
    dirty = F.replace(_dirty(_only_cyr(F.col("text"))), F.lit("e"), F.lit("\u0435"))
    return _texts(spark, d).select("doc_id", text.normalize(dirty).alias("n")).select("doc_id", "n.hint", F.sha2("n.text", 256).alias("sha"))


# Tables and paragraphs ---------------------------------------------------------


def _region_tables(spark, d) -> DataFrame:
    row = F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit(" "), "n_name", F.lit("\nx ")), F.lit(None).cast("string"))
    rows = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = F.array(F.array(F.lit("key"), F.lit("name")))
    return _t(spark, d, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "r_name", F.concat(head, "rows").alias("cells"))


_CELL = "coalesce(replace(trim(c, ' ' || chr(10)), chr(10), ' '), '')"


@query(rf"""
WITH n AS (SELECT n_regionkey AS r_regionkey, list([n_nationkey::VARCHAR, ' ' || n_name || chr(10) || 'x ', NULL] ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1),
t AS (SELECT r_regionkey, list_concat([['key', 'name', NULL]], rows) AS cells FROM n),
l AS (SELECT r_regionkey, list_transform(cells, lambda r: '| ' || array_to_string(list_transform(r, lambda c: {_CELL}), ' | ') || ' |') AS l FROM t)
SELECT r_regionkey, l[1] || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(l[2:], chr(10)) AS markdown FROM l""")
def table_markdown(spark, d):
    return _region_tables(spark, d).select("r_regionkey", tables.to_markdown(F.col("cells")).alias("markdown"))


@query("SELECT r_regionkey, count(*) >= 1 AS whole, false AS head_only, false AS one_column, false AS long_cell FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def table_guard(spark, d):
    c = F.col("cells")
    long_cell = F.concat(c, F.array(F.array(F.repeat(F.lit("x"), 301), F.lit("y"))))
    shapes = {"whole": c, "head_only": F.slice(c, 1, 1), "one_column": F.transform(c, lambda r: F.slice(r, 1, 1)), "long_cell": long_cell}
    return _region_tables(spark, d).select("r_regionkey", *[tables.looks_like_table(v).alias(k) for k, v in shapes.items()])


@query(S.PARAGRAPHS)
def paragraph_blocks(spark, d):
    rows = _grouped(spark, d)
    return rows.select("doc_id", "block", F.sha2("content", 256).alias("sha"), F.length("content").alias("n"), "page")


def _grouped(spark, d) -> DataFrame:
    @F.pandas_udf("array<struct<content: string, page: int>>")
    def grouped(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"content": c, "page": p} for c, p in files.grouped_paragraphs((x or "").split("\n"))])

    return _texts(spark, d).select("doc_id", F.posexplode(grouped("text")).alias("block", "b")).select("doc_id", "block", "b.content", "b.page")


@query(f"SELECT doc_id, count(*) AS n_blocks, count(*) AS n_text, 0::BIGINT AS n_table, sum(n)::BIGINT AS chars, max(n)::BIGINT AS longest, max(page)::INT AS pages FROM ({S.PARAGRAPHS}) GROUP BY 1")
def ingest_report(spark, d):
    return reports.block_report(_grouped(spark, d).withColumn("kind", F.lit("text")), "doc_id")


@query("SELECT doc_id, i::INT AS line, greatest(1, (sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i)) // 1500)::INT AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)")
def page_approx(spark, d):
    lines = _texts(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", "line", F.greatest(F.lit(1), F.floor(F.sum(F.length("l") + 1).over(upto) / 1500)).cast("int").alias("page"))


# Chunking ----------------------------------------------------------------------


def _legal(spark, d) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when((i + 1) % 5 == 0, F.concat(F.lit("Ilova "), (i + 1).cast("string"), F.lit(" "))).otherwise(F.concat((i + 1).cast("string"), F.lit("-modda. "))), x))
    return _texts(spark, d).select("doc_id", F.lit("text").alias("kind"), F.array_join(lines, "\n").alias("content"))


def _segments(spark, d) -> DataFrame:
    return chunk.segment_rows(_legal(spark, d), ["doc_id"])


@query(S.HEADINGS)
def heading_forms(spark, d):
    # Lines get headings of all kinds, in either case; two in twenty have none, so that texts have preambles and longer bodies.
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.get(F.array(*map(F.lit, S.HEADS)), (i + F.col("doc_id")).cast("int") % len(S.HEADS)), x))
    rows = _texts(spark, d).select("doc_id", F.array_join(lines, "\n").alias("content"))
    return chunk.segment_rows(rows, ["doc_id"]).select("doc_id", "off", "label", F.sha2("content", 256).alias("sha"))


@query(f"WITH {S.LEGAL} SELECT doc_id, off::INT AS off, label FROM heads")
def article_boundaries(spark, d):
    return _segments(spark, d).select("doc_id", "off", "label")


@query(f"WITH {S.LEGAL} SELECT doc_id, off::INT AS off, sha256({S.strip('line')}) AS sha FROM heads")
def article_segments(spark, d):
    return _segments(spark, d).select("doc_id", "off", F.sha2("content", 256).alias("sha"))


@query(f"""
WITH {S.LEGAL}, c AS (SELECT *, last_value(CASE WHEN lower(label) LIKE '%ilova%' THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY off) AS ctx FROM heads)
SELECT doc_id, off::INT AS off, CASE WHEN ctx IS NULL OR lower(label) LIKE '%ilova%' THEN label ELSE ctx || ' / ' || label END AS article_label FROM c""")
def annex_context(spark, d):
    return chunk.with_annex(_segments(spark, d), ["doc_id"], ["off"]).select("doc_id", "off", "article_label")


@query(f"WITH {S.pieces('SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL')} SELECT id AS doc_id, piece, length(content)::INT AS n, sha256(content) AS sha FROM pieces")
def recursive_split(spark, d):
    rows = _texts(spark, d).select("doc_id", F.posexplode(chunk.split_column(F.col("text"), 800, 120)).alias("piece", "content"))
    return rows.select("doc_id", "piece", F.length("content").alias("n"), F.sha2("content", 256).alias("sha"))


@query("SELECT doc_id, true AS short, true AS found, true AS begins, true AS ends, true AS whole, CASE WHEN length(text) <= 800 THEN 1::BIGINT END AS n_short FROM documents WHERE text IS NOT NULL AND (length(text) <= 800 OR regexp_matches(text, '[^ \n]'))")
def split_laws(spark, d):
    """What holds of the pieces of every text: their size, places, ends, and that nothing but white space is left out."""
    docs = _texts(spark, d).where("text is not null").select("doc_id", "text", chunk.split_column(F.col("text"), 800, 120).alias("p"))
    t, marks = F.col("text"), lambda c: F.length(F.regexp_replace(c, r"[\x00-\x20]", ""))
    laws = {
        "short": F.forall("p", lambda c: F.length(c) <= 800),
        "found": F.forall("p", lambda c: F.contains(t, c)),
        "begins": F.ltrim(F.regexp_replace(t, r"^\s+", "")).startswith(F.get("p", F.lit(0))) | (F.length(t) <= 800),
        "ends": F.regexp_replace(t, r"\s+\z", "").endswith(F.element_at("p", -1)) | (F.length(t) <= 800),
        "whole": F.aggregate("p", F.lit(0), lambda a, c: a + marks(c)) >= marks(t),
        "n_short": F.when(F.length(t) <= 800, F.size("p").cast("long")),
    }
    return docs.where(F.size("p") > 0).select("doc_id", *[v.alias(k) for k, v in laws.items()])


@query(S.CHUNKS)
def chunk_documents(spark, d):
    rows = _legal(spark, d).select(
        F.col("doc_id").cast("string").alias("source_path"), F.col("doc_id").cast("string").alias("filename"), F.sha2("content", 256).alias("file_hash"),
        F.lit("en").alias("language_hint"), F.lit(0).alias("block_idx"), "kind", "content", F.lit(1).alias("page"),
    )
    return chunk.chunk_blocks(rows)


def _line_chunks(spark, d) -> DataFrame:
    lines = _texts(spark, d).select(F.col("doc_id").cast("string").alias("source_path"), F.lit(None).cast("string").alias("article_label"), F.lit("f").alias("filename"), F.sha2("text", 256).alias("file_hash"), F.lit("en").alias("language_hint"), F.lit("text").alias("kind"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return chunk.numbered(lines.withColumn("content", text.strip(F.col("content"))).where(F.length("content") >= 30), ["line"])


_LINE_SQL = f"""
WITH l AS (SELECT doc_id::VARCHAR AS source_path, sha256(text) AS file_hash, {S.strip('x')} AS content, i FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT *, row_number() OVER (PARTITION BY source_path, file_hash ORDER BY i) - 1 AS n FROM l WHERE length(content) >= 30),
c AS (SELECT source_path, file_hash, printf('%s_%04d', file_hash[1:8], n) AS chunk_id, greatest(1, length(content) // 4)::INT AS token_estimate, content FROM k) """


@query(_LINE_SQL + "SELECT source_path, count(*) AS n FROM c GROUP BY 1")
def chunk_min_len(spark, d):
    return reports.count_by(_line_chunks(spark, d), "source_path")


@query(_LINE_SQL + "SELECT source_path, chunk_id FROM c")
def chunk_ids(spark, d):
    return _line_chunks(spark, d).select("source_path", "chunk_id")


@query(_LINE_SQL + "SELECT chunk_id, token_estimate, source_path FROM c")
def token_estimate(spark, d):
    return _line_chunks(spark, d).select("chunk_id", "token_estimate", "source_path")


@query(_LINE_SQL + "SELECT chunk_id, file_hash, 'f' AS filename, source_path, 1::INT AS page, '' AS article_label, 'text' AS kind, 'en' AS language_hint, 'general' AS department, 'internal' AS access_level, 'v1' AS doc_version FROM c")
def chunk_metadata(spark, d):
    return index.chunk_metadata(_line_chunks(spark, d))


# Index maintenance -------------------------------------------------------------


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two states of all documents: some vanish, some appear, some change."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_path"), "doc_id", F.sha2("text", 256).alias("file_hash"))
    old = docs.where("doc_id % 10 <> 3")
    new = docs.where("doc_id % 10 <> 7").withColumn("file_hash", F.when(F.col("doc_id") % 10 == 5, F.sha2(F.concat("file_hash", F.lit("+")), 256)).otherwise(F.col("file_hash")))
    return old, new


_SNAP = """
WITH d AS (SELECT doc_id::VARCHAR AS source_path, doc_id, sha256(text) AS h FROM documents),
o AS (SELECT source_path, h AS old_hash FROM d WHERE doc_id % 10 <> 3),
n AS (SELECT source_path, CASE WHEN doc_id % 10 = 5 THEN sha256(h || '+') ELSE h END AS new_hash FROM d WHERE doc_id % 10 <> 7),
c AS (SELECT source_path, new_hash, old_hash, CASE WHEN old_hash IS NULL THEN 'new' WHEN new_hash IS NULL THEN 'deleted' WHEN old_hash = new_hash THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (source_path)) """


@query(_SNAP + "SELECT * FROM c")
def manifest_diff(spark, d):
    old, new = _snapshots(spark, d)
    return index.classify(new, old)


@query(_SNAP + "SELECT count(*) AS total_seen, count(*) FILTER (status <> 'deleted') AS total, count(*) FILTER (status IN ('new', 'changed')) AS added, count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status = 'deleted') AS deleted FROM c")
def index_summary(spark, d):
    old, new = _snapshots(spark, d)
    changes = index.classify(new, old)
    return index.run_summary(changes).select((F.col("total") + F.col("deleted")).alias("total_seen"), "total", "added", "skipped", "deleted")


@query(_SNAP + "SELECT source_path, h AS file_hash FROM d WHERE doc_id % 10 <> 3 AND h NOT IN (SELECT old_hash FROM c WHERE status = 'changed')")
def apply_delete_hash(spark, d):
    old, new = _snapshots(spark, d)
    gone = index.classify(new, old).where("status = 'changed'").select(F.col("old_hash").alias("file_hash"))
    return index.delete_where(old.select("source_path", "file_hash"), gone, "file_hash")[0]


@query(_SNAP + "SELECT count(*) AS deleted FROM c WHERE status = 'deleted'")
def apply_delete_path(spark, d):
    old, new = _snapshots(spark, d)
    gone = index.classify(new, old).where("status = 'deleted'").select("source_path")
    return index.delete_where(old.select("source_path", "file_hash"), gone, "source_path")[1]


@query(_SNAP + "SELECT h AS chunk_id, max(doc_id) AS doc_id FROM d GROUP BY 1")
def upsert_last_wins(spark, d):
    docs = _t(spark, d, "documents").select(F.sha2("text", 256).alias("chunk_id"), "doc_id")
    return index.upsert(docs.where("doc_id < 0"), docs, order="doc_id")


@query(_SNAP + "SELECT old_hash AS chunk_id, source_path::BIGINT AS doc_id, 'old' AS version FROM o WHERE old_hash NOT IN (SELECT new_hash FROM n) UNION ALL SELECT new_hash, max(source_path::BIGINT), 'new' FROM n GROUP BY 1")
def upsert_snapshots(spark, d):
    old, new = (s.select(F.col("file_hash").alias("chunk_id"), "doc_id", F.lit(v).alias("version")) for s, v in zip(_snapshots(spark, d), ("old", "new"), strict=True))
    return index.upsert(old, new, order="doc_id")


def _as_files(spark, d) -> DataFrame:
    """source, no, file, content: twenty documents of a source a file; every tenth is named as DOCX, which it isn't."""
    rows = _t(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.floor(F.col("doc_id") / 20).alias("no"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("r"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["text"]), "\n")
    made = rows.groupBy("source", "no").agg(F.concat(whole, F.lit("\n")).alias("content"))
    return made.withColumn("path", F.concat("source", F.lit("/"), "no", F.when(F.col("no") % 10 == 1, ".docx").otherwise(".txt")))


@query(S.FILES_READ)
def files_read(spark, d):
    raw = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    files.put(_as_files(spark, d), raw)
    docs = files.load(files.scan(spark, raw))
    of = files.relative(F.col("source_path"), raw).alias("file")
    return docs.select(of, "file_hash", F.col("error").isNotNull().alias("failed"), "total_pages", F.size("blocks").alias("n_blocks"), "language_hint", F.sha2(F.get("blocks", F.lit(0))["content"], 256).alias("sha"))


@query(S.LIFE_CYCLE)
def index_life_cycle(spark, d):
    # A folder is indexed, files come, change and go, and it is indexed again.
    at = f"{shared_folder(spark)}/life-{uuid.uuid4().hex}"
    raw, out = f"{at}/raw", f"{at}/index"
    texts, n = _as_files(spark, d), F.col("no") % 10
    files.put(texts.where(n != 3), raw)
    build.build_index(spark, raw, out)
    more = F.when(n == 5, F.concat("content", F.lit("One line more stands at the end of this file."))).when(n == 3, F.col("content"))
    files.put(texts.where(n.isin(3, 5, 7)).withColumn("content", more), raw)
    build.build_index(spark, raw, out)
    seen = spark.read.parquet(f"{out}/changes/version=2").select("source_path", "status")
    held = build.manifest(spark, out).select("source_path", "file_hash", "chunk_count")
    of = lambda rows, name: rows.groupBy("source_path").agg(F.count("*").alias(name))
    rows = seen.join(held, "source_path", "left").join(of(build.chunks(spark, out), "n_chunks"), "source_path", "left").join(of(build.vectors(spark, out), "n_vectors"), "source_path", "left")
    return rows.na.fill(0, ["n_chunks", "n_vectors"]).select(files.relative(F.col("source_path"), raw).alias("file"), "status", "file_hash", "chunk_count", "n_chunks", "n_vectors")


_BUCKET = "(('0x' || md5(source_path)[1:8])::BIGINT % 256)::INT"


@query(f"""
WITH d AS (SELECT doc_id::VARCHAR AS source_path, doc_id, sha256(text) AS h, {_BUCKET.replace('source_path', 'doc_id::VARCHAR')} AS bucket FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 100 IN (3, 5) THEN sha256(h || '+') ELSE h END AS file_hash FROM d WHERE doc_id % 100 <> 7),
v AS (SELECT bucket, max(CASE WHEN doc_id % 100 = 7 THEN 3 WHEN doc_id % 100 IN (3, 5) THEN 2 ELSE 1 END)::INT AS version FROM d GROUP BY 1)
SELECT source_path, file_hash, bucket, version FROM s JOIN v USING (bucket)""")
def upsert_buckets(spark, d):
    # All documents but some, an upsert that adds and changes, a delete; version is that of the bucket.
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_path"), "doc_id", F.sha2("text", 256).alias("file_hash"))
    last = F.pmod("doc_id", F.lit(100))
    table = buckets.BucketTable.create(docs.where(last != 3).drop("doc_id"), f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}", ["source_path"], 256)
    changed = docs.where(last.isin(3, 5))
    twice = changed.withColumn("at", F.lit(1)).unionByName(changed.withColumns({"file_hash": F.sha2(F.concat("file_hash", F.lit("+")), 256), "at": F.lit(2)}))
    table.upsert(twice, order="at")
    table.delete(docs.where(last == 7))
    return table.read().select("source_path", "file_hash", "bucket", "version")


# Conversations -----------------------------------------------------------------


def _turns(spark, d, n: int | None = None) -> DataFrame:
    """Turns with what came before them in their conversation: all of it, or the last n turns."""
    first = Window.unboundedPreceding if n is None else -n
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(first, -1)
    history = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before)
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", "text", history.cast(agent.TURNS).alias("history"))


@query(f"SELECT conv_id, turn, {S.followup('text')} AS followup FROM conversations")
def followup_heuristic(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", agent.is_followup(F.col("text")).alias("followup"))


@query("""
SELECT conv_id, turn, coalesce(string_agg(upper(role) || ': ' || left(text, 400), chr(10) ORDER BY k) FILTER (k IS NOT NULL), '(no previous turns)') AS history
FROM (SELECT c.conv_id, c.turn, p.role, p.text, p.turn AS k FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) c
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) p ON p.conv_id = c.conv_id AND p.r BETWEEN c.r - 4 AND c.r - 1)
GROUP BY ALL""")
def history_window(spark, d):
    return _turns(spark, d, 4).select("conv_id", "turn", agent.history_text(F.col("history")).alias("history"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS last_user FROM conversations")
def last_user_turn(spark, d):
    return agent.with_last_user(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "last_user")


@query(S.GATES)
def contextualize_gates(spark, d):
    rows = agent.with_last_user(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    n, last = F.col("turn") % 5, F.col("last_user")
    new = F.when(n == 0, F.translate("text", S.ABC, S.ABC.upper())).when(n == 1, "ab").when(n == 2, text.strip(last)).when(n == 3, "entirely other words stand here").otherwise(F.concat("text", F.lit(" more")))
    rows = agent.with_asked_before(rows.withColumn("rewritten", new), "conv_id", "turn", "role", "text", "rewritten")
    rows = rows.withColumn("reason", agent.gate(F.col("text"), F.col("rewritten"), F.col("asked_before")))
    return rows.select("conv_id", "turn", "reason", F.when(F.col("reason").isNotNull(), agent.joined_with(F.col("text"), last)).otherwise(F.col("rewritten")).alias("final"))


# Grading and routing -----------------------------------------------------------


def _graded(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    return retrieve.vector_topk(v, _probe(v, F.col("key") % 100 == 0), 20)


_SCORES = S.vector_top("vec_id % 100 = 0", 20)


@query(f"SELECT query_id, key, CASE WHEN score >= 0.5 THEN 'accept' WHEN score <= 0.1 THEN 'reject' ELSE 'grade' END AS band FROM ({_SCORES})")
def grade_bands(spark, d):
    return _graded(spark, d).select("query_id", "key", agent.band(F.col("score")).alias("band"))


@query(f"SELECT query_id, s[len(s) // 2 + 1] AS upper_median FROM (SELECT query_id, list(score ORDER BY score DESC) AS s FROM ({_SCORES}) GROUP BY 1)")
def upper_median(spark, d):
    return _graded(spark, d).groupBy("query_id").agg(agent.upper_median(F.collect_list("score")).alias("upper_median"))


@query(f"SELECT query_id, len(s) >= 2 AND s[1] >= 0.9 AND s[len(s) // 2 + 1] >= 0.6 AS high FROM (SELECT query_id, list(score + (CASE WHEN query_id % 200 = 0 THEN 0.5 ELSE 0 END) ORDER BY score DESC) AS s FROM ({_SCORES}) WHERE rank <= 3 GROUP BY 1)")
def high_confidence(spark, d):
    score = F.col("score") + F.when(F.col("query_id") % 200 == 0, 0.5).otherwise(0.0)
    return _graded(spark, d).where("rank <= 3").groupBy("query_id").agg(agent.high_confidence(F.collect_list(score)).alias("high"))


@query(S.ROUTES)
def route_next(spark, d):
    # Every turn is a state of the loop, read off its numbers.
    k = F.col("conv_id") * 8 + F.col("turn")
    part = lambda by, n: F.pmod(F.floor(k / by), F.lit(n)).cast("int")
    state = {"node": F.lit(S.NODES)[part(1, 8)], "n_relevant": part(8, 3), "rewrites": part(24, 4), "generations": part(96, 5), "high": part(7, 3) == 1, "grounded": part(3, 2) == 1, "answers": part(5, 2) == 1}
    cases = _t(spark, d, "conversations").select("conv_id", "turn", *[v.alias(c) for c, v in state.items()])
    return cases.withColumn("following", agent.route(*[F.col(c) for c in state], Agent()))


@query(f"""
WITH t AS ({S.bm25_top(S.asked(1), 3)})
SELECT query_id, string_agg('[' || rank || '] (' || source || ', p.1, «' || (CASE WHEN doc_id % 2 = 0 THEN '-' ELSE lang END) || '»)' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS passages
FROM t JOIN documents ON doc_id = key GROUP BY 1""")
def format_passages(spark, d):
    return _passages(spark, d, _asked(spark).where("query_id = 1"), 3).select("query_id", agent.format_passages(F.col("passages")).alias("passages"))


def _passages(spark, d, asked: DataFrame, k: int, table: DataFrame | None = None, counts: index.TermCounts | None = None, content: Column | None = None) -> DataFrame:
    docs = _docs(spark, d)
    hits = retrieve.bm25_topk_long(index.token_table(docs, "key", "text") if table is None else table, asked, k, zero_fill=False, counts=counts)
    label = F.when(F.col("key") % 2 == 0, "").otherwise(F.col("lang"))
    one = F.struct(F.col("key").cast("string").alias("chunk_id"), (F.col("text") if content is None else content).alias("content"), F.col("department").alias("filename"), F.lit(1).alias("page"), label.alias("article_label"), F.lit("v1").alias("doc_version"), (F.col("score") / 20).alias("score"))
    rows = docs.join(hits, "key").select("query_id", F.struct("rank", one.alias("p")).alias("r"))
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["p"]).alias("passages"))


@query(S.VERDICTS)
def json_verdicts(spark, d):
    n, said = F.col("event_id") % 6, F.concat(F.lit('{"relevant": "yes", "reason": "'), "event_type", F.lit('"}'))
    reply = (
        F.when(n == 0, said)
        .when(n == 1, F.concat(F.lit("```json\n"), F.replace(said, F.lit("yes"), F.lit("no")), F.lit("\n```")))
        .when(n == 2, F.replace(said, F.lit("yes"), F.lit("maybe")))
        .when(n == 3, F.concat(said, F.lit(" "), said))
        .when(n == 4, F.replace(said, F.col("event_type"), F.repeat(F.lit("x"), 301)))
        .otherwise(F.col("event_type"))
    )
    return _t(spark, d, "events").select("event_id", F.coalesce(agent.yes_no(reply, "relevant"), F.lit("no")).alias("verdict"))


@query()
def agent_batch(spark, d):
    turns = _turns(spark, d).where("role = 'user'")
    asked = turns.select(F.format_string("%d-%d", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"), "history")
    # Every round of the loop searches the same documents, so they are cut into words and counted once.
    table = kept(index.token_table(_docs(spark, d), "key", "text"), "tokens")
    counts = index.term_counts(table)
    texts = _docs(spark, d).select(F.col("key").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    out = agent.answer_batch(asked, lambda q: _passages(spark, d, q, 5, table, counts, F.lit(None).cast("string")), contents=texts)
    return out.select("query_id", "final_reason", "answer", "rewrite_count", "generation_count", "steps", F.size("relevant").alias("n_relevant"))


# Audit and reports -------------------------------------------------------------


@query("SELECT 'general' AS department, 'internal' AS clearance, text AS query, role AS answer, [conv_id::VARCHAR] AS sources, [turn::VARCHAR] AS trace, role = 'user' AS flagged FROM conversations")
def audit_rows(spark, d):
    passage = F.struct(F.lit("f").alias("filename"), F.lit(1).alias("page"), F.lit("").alias("article_label"), F.col("conv_id").cast("string").alias("chunk_id"), F.lit("v1").alias("doc_version"), F.lit("long").alias("content"))
    made = _t(spark, d, "conversations").select(F.lit("general").alias("department"), F.lit("internal").alias("clearance"), F.col("text").alias("query"), F.col("role").alias("answer"), F.array(passage).alias("relevant"), F.array(F.col("turn").cast("string")).alias("trace"))
    return audit.audit_rows(made, F.col("answer") == "user").drop("timestamp").withColumn("sources", F.transform("sources", lambda s: s["chunk_id"]))


@query("SELECT conv_id, text, max(role = 'user') AS flagged, count(*) AS n_rows FROM conversations GROUP BY ALL")
def audit_flag_latest(spark, d):
    return audit.latest_flags(_t(spark, d, "conversations").withColumn("flagged", F.col("role") == "user"), "conv_id", "text")


_SIZES = "count(*) AS n, min(length(text)) AS min_size, (sum(length(text)) // count(*))::BIGINT AS avg_size, max(length(text)) AS max_size, count(*) FILTER (length(text) < 100) AS tiny, count(*) FILTER (length(text) BETWEEN 100 AND 299) AS small, count(*) FILTER (length(text) >= 300) AS \"full\""


@query(f"SELECT source, {_SIZES}, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents GROUP BY 1")
def chunk_report(spark, d):
    return reports.size_report(_t(spark, d, "documents"), ["source"], F.length("text"), tokens=F.greatest(F.lit(1), F.floor(F.length("text") / 4)))


@query(f"SELECT lang, {_SIZES} FROM documents GROUP BY 1")
def size_buckets(spark, d):
    return reports.size_report(_t(spark, d, "documents"), ["lang"], F.length("text"))


@query(f"WITH {S.LEGAL} SELECT label, count(*) AS n, min(doc_id * 1000000 + off)::BIGINT AS first_seen FROM heads GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 15")
def label_top15(spark, d):
    return reports.top_labels(_segments(spark, d).withColumn("at", F.col("doc_id") * 1000000 + F.col("off")), "label", "at")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY source) // 10) AS m FROM documents) WHERE r % m = 0 AND r // m < 10")
def stride_sample(spark, d):
    return reports.stride_sample(_t(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"])


@query("SELECT DISTINCT source AS department FROM documents")
def departments_distinct(spark, d):
    return reports.departments(_t(spark, d, "documents"), "source")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def count_by_kind(spark, d):
    return reports.count_by(_t(spark, d, "documents"), "lang")


@query("SELECT doc_id, replace(left(text, 60), chr(10), ' ') AS preview FROM documents")
def previews(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 60).alias("preview"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 50 = d.doc_id % 50 AND length(d.text) % 100 BETWEEN length(p.url) AND length(p.url) + 5)")
def chars_outside_boxes(spark, d):
    x = (F.length("text") % 100).cast("double")
    chars = _t(spark, d, "documents").select("doc_id", F.lit(1).alias("doc"), (F.col("doc_id") % 50).alias("page"), x.alias("x0"), x.alias("x1"), F.lit(1.0).alias("top"), F.lit(1.0).alias("bottom"))
    n = F.length("url").cast("double")
    boxes = _t(spark, d, "pages").select(F.lit(1).alias("doc"), (F.col("page_id") % 50).alias("page"), n.alias("x0"), (n + 5).alias("x1"), F.lit(0.0).alias("top"), F.lit(2.0).alias("bottom"))
    return files.outside(chars, boxes).select("doc_id")
