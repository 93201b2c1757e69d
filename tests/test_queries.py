import duckdb
import pytest
from millrace.plans import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that build on an order within a text or a group: held against their SQL on more rows too.
ORDERED = ("article_segments", "chunk_documents", "heading_forms", "history_window", "index_life_cycle", "page_approx", "paragraph_blocks", "recursive_split", "split_laws", "stride_sample")
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    def opened(sf):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        return con

    return {sf: opened(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize(("name", "sf"), [(n, SF) for n in sorted(catalog.ORACLE_SQL)] + [(n, LARGER) for n in ORDERED])
def test_twin(spark, duck, name, sf):
    got = catalog.QUERIES[name](spark, sf).toArrow()
    want = duck[sf].execute(catalog.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    show = lambda t: sorted(repr(sorted(r.items())) for r in t.to_pylist())
    assert show(got) == show(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_passages_are_asked_whole(spark):
    # The last word of a passage is past any prefix; its documents must score for it.
    table = catalog.index.token_table(catalog._docs(spark, SF), "key", "text")
    whole = {(r["query_id"], r["key"]): r["score"] for r in catalog.QUERIES["bm25_batch"](spark, SF).collect()}
    asked = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {q for q, _ in whole} == set(asked)
    rows = spark.createDataFrame([(q * 100 + k, w) for q, t in list(asked.items())[:4] for k, w in enumerate(t.split())], "query_id int, query string")
    summed = {}
    for r in catalog.retrieve.bm25_scores(table, rows).collect():
        at = (r["query_id"] // 100, r["key"])
        summed[at] = summed.get(at, 0) + r["score"]
    for q in list(asked)[:4]:
        best = sorted((v for (k, _), v in summed.items() if k == q), reverse=True)[:5]
        got = sorted((v for (k, _), v in whole.items() if k == q), reverse=True)
        assert got == pytest.approx(best, abs=1e-3)


def test_long_queries_rank_as_others(spark):
    table = catalog.index.token_table(catalog._docs(spark, SF), "key", "text")
    asked = catalog._asked(spark)
    shown = [sorted((r["query_id"], r["rank"], r["key"], r["score"]) for r in f(table, asked, 7).collect()) for f in (catalog.retrieve.bm25_topk, catalog.retrieve.bm25_topk_long)]
    assert shown[0] == shown[1] and {q for q, *_ in shown[0]} == {1, 2, 3}
    assert catalog.retrieve.bm25_topk_long(table, asked.where("query_id = 4"), 7).count() == 0


def test_upsert_keeps_replaces_and_adds(spark):
    old, new = ({r["file_hash"] for r in s.collect()} for s in catalog._snapshots(spark, SF))
    got = catalog.QUERIES["upsert_snapshots"](spark, SF).collect()
    by = {v: {r["chunk_id"] for r in got if r["version"] == v} for v in ("old", "new")}
    assert by == {"old": old - new, "new": new} and old - new and old & new and new - old
    assert sum(r["version"] == "new" for r in got) == len(new)


def test_fusion_and_reranking_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(catalog.retrieve, "QUERIES", 1)
    want = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
    rows = catalog.QUERIES["rrf_batch"](spark, SF).collect()
    assert {r["query_id"] for r in rows} == want and len(want) > 1
    first = {(r["query_id"], r["key"]) for r in rows if r["source"] == "bm25" and r["leg_rank"] == 1}
    assert first == {(r["query_id"], r["query_id"]) for r in catalog._queries(spark, SF).collect()} and len(first) > 1
