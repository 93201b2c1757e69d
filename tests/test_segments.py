"""The stored lexical index against counting over bare rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from millrace.functions import packed
from millrace.operators import index, retrieve, segments
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(21)
    weights = [1 / (i + 1) for i in range(40)]
    out = []
    for k in range(700):
        n = rnd.choice([0, 1, 3, 8, 20, 60])
        out.append((k, f"d{k % 3}", ("public", "internal", "confidential")[k % 2 if k % 7 else 2], " ".join(rnd.choices(WORDS, weights, k=n))))
    return [*out, (700, "d1", "public", None), (701, "general", "public", "w1 w1 w39"), (702, None, "public", "w1"), (703, "d1", None, "w1 w2")]


SCHEMA = "key long, department string, access_level string, text string"


def asked(spark, readers=False):
    rows = [(1, "w0 w3 w3"), (2, "w39 w38"), (3, "nothing here"), (4, "w20"), (5, "... "), (6, "W1 w2 w5 w9 w30")]
    if not readers:
        return spark.createDataFrame(rows, "query_id int, query string")
    who = [("d1", "public"), ("d2", "internal"), ("general", "confidential"), ("d0", "odd"), (None, "internal")]
    return spark.createDataFrame([(q * 10 + i, t, *w) for q, t in rows for i, w in enumerate(who)], "query_id int, query string, department string, clearance string")


def shown(df):
    return sorted((r["query_id"], r["rank"], r["key"], r["score"]) for r in df.collect())


def bare(spark, now, k, queries):
    docs = spark.createDataFrame(now, SCHEMA)
    allowed = None
    if "clearance" in queries.columns:
        allowed = segments.open_to(queries).join(docs, ["department", "access_level"]).select("query_id", "key")
    return shown(retrieve.bm25_topk(index.token_table(docs, "key", "text"), queries.select("query_id", "query"), k, allowed=allowed))


def test_versions_score_as_one_index(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(segments, "CELL", 8)
    monkeypatch.setattr(segments, "FOLDER", 1500)
    path, now = str(tmp_path / "lexical"), {r[0]: r for r in rows[:400]}
    make = lambda some: spark.createDataFrame(some, SCHEMA)
    segments.append(spark, path, 1, make(list(now.values())))
    # New, changed (under the same keys), and removed ones; then a version without any, and one that only removes.
    changed = [(k, "d2", "public", "w39 w39 w0") for k in range(0, 60, 3)]
    ended = [now[k] for k in range(0, 60)]
    added = [*changed, *rows[400:]]
    segments.append(spark, path, 2, make(added), make(ended))
    now = {k: r for k, r in now.items() if k >= 60} | {r[0]: r for r in added}
    segments.append(spark, path, 3, make([]))
    last = [now.pop(k) for k in range(300, 330)]
    segments.append(spark, path, 4, make([]), make(last))
    assert len(set((tmp_path / "lexical/cells/version=1").glob("*/*/part=*"))) > 3
    segments.compact(spark, path, f"{path}-one", 4)
    for queries, k, many in ((asked(spark), 25, True), (asked(spark, readers=True), 3, False)):
        got = segments.Search(spark, path, queries, k, 4) if many else segments.Search(spark, f"{path}-one", queries, k, 1)
        assert shown(got.filled()) == bare(spark, list(now.values()), k, queries)
    assert shown(segments.Search(spark, path, asked(spark), 5, 1).filled()) == bare(spark, rows[:400], 5, asked(spark))


def test_a_segment_is_written_in_proportion(spark, tmp_path, rows):
    path = str(tmp_path / "lexical")
    segments.append(spark, path, 1, spark.createDataFrame(rows, SCHEMA))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "lexical").rglob("*.parquet")}
    segments.append(spark, path, 2, spark.createDataFrame([(9000, "d1", "public", "w0 newword")], SCHEMA))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert spark.read.parquet(f"{path}/cells/version=2").count() == 2 and spark.read.parquet(f"{path}/terms/version=2").count() == 2
    # Written again, as after a broken run: the same segment.
    segments.append(spark, path, 2, spark.createDataFrame([(9000, "d1", "public", "w0 newword")], SCHEMA))
    hit = segments.Search(spark, path, spark.createDataFrame([(1, "newword")], "query_id int, query string"), 3, 2).hits().collect()
    assert [r["key"] for r in hit] == [9000]


def test_bounds_skip_cells_and_leave_the_ranking(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "CELL", 4)
    rnd = random.Random(22)
    rows = [(k, "d", "public", " ".join(rnd.choices(WORDS[:30], k=10)) + (" w35" * 5 if k % 97 == 0 else " w35" if k % 11 == 0 else "")) for k in range(1500)]
    path = str(tmp_path / "lexical")
    segments.append(spark, path, 1, spark.createDataFrame(rows, SCHEMA))
    queries = spark.createDataFrame([(1, "w35"), (2, "w35 w1")], "query_id int, query string")
    search = segments.Search(spark, path, queries, 5, 1)
    assert shown(search.filled()) == bare(spark, rows, 5, queries)
    seen = {r["query_id"]: (r["cells"], r["read"]) for r in search.report().collect()}
    assert seen[1][1] < 0.7 * seen[1][0] and seen[2][1] < seen[2][0], seen


def test_closed_folders_are_not_read(spark, tmp_path, rows):
    path = str(tmp_path / "lexical")
    segments.append(spark, path, 1, spark.createDataFrame(rows, SCHEMA))
    queries = spark.createDataFrame([(1, "w0 w1", "d1", "public")], "query_id int, query string, department string, clearance string")
    search = segments.Search(spark, path, queries, 5, 1)
    plan = search.cells._jdf.queryExecution().executedPlan().toString()
    assert "access_level" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    read = {(r["department"], r["access_level"]) for r in search.cells.select("department", "access_level").distinct().collect()}
    assert read <= {("d1", "public"), ("general", "public")}
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    none = spark.createDataFrame([(1, "w0", "nowhere", "public")], "query_id int, query string, department string, clearance string")
    assert {r["key"] for r in segments.Search(spark, path, none, 5, 1).filled().collect()} == {701}


def test_counting_words_in_their_row(spark):
    got = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"])], "k int, w array<string>").select("k", segments._counted(F.col("w")).alias("c")).collect()
    assert {r["k"]: {x["term"]: x["tf"] for x in r["c"]} for r in got} == {1: {"a": 1, "b": 3, "c": 1}, 2: {}, 3: {"x": 1}}


def test_folders_hold_as_many_postings_as_stated(spark, tmp_path, rows, monkeypatch):
    # Nine folders of departments and levels, and more: parts follow the largest folder's postings, not those of all.
    monkeypatch.setattr(segments, "FOLDER", 1500)
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = docs.select("department", "access_level", F.size(F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n")).groupBy("department", "access_level").agg(F.sum("n").alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    assert most < 1500 < total / 2
    segments.append(spark, str(tmp_path / "lex"), 1, docs)
    segments.compact(spark, str(tmp_path / "lex"), str(tmp_path / "one"), 1)
    for name in ("lex", "one"):
        cells = spark.read.parquet(str(tmp_path / name / "cells"))
        assert cells.select("part").distinct().count() == 1
        assert cells.agg(F.sum(F.size("keys"))).first()[0] == total


def shuffled(spark, since):
    """Bytes that stages after the given one wrote to shuffles, and the last stage."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    all_ = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in all_ if s.stageId() > since), max((s.stageId() for s in all_), default=-1)


def test_a_segment_moves_less_than_its_texts(spark, tmp_path):
    rnd = random.Random(23)
    rows = [(k, f"d{k % 3}", "public", " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(200))) for k in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(4).write.parquet(str(tmp_path / "docs"))
    docs, path = spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "lexical")
    last = shuffled(spark, -1)[1]
    segments.append(spark, path, 1, docs)
    moved, last = shuffled(spark, last)
    segments.compact(spark, path, f"{path}-one", 1)
    again, _ = shuffled(spark, last)
    texts = sum(len(r[3]) for r in rows)
    assert 0 < moved < 0.5 * texts and 0 < again < 0.5 * texts, (moved, again, texts)


def test_small_cells_become_one(spark, tmp_path):
    # Segments of one chunk each, some of which end; keys are texts.
    path, now = str(tmp_path / "lexical"), {}
    make = lambda some: spark.createDataFrame(some, SCHEMA.replace("key long", "key string"))
    for v, (text, ends) in enumerate([("a b b", None), ("b c", None), ("c", "k1"), ("a c c", None)], 1):
        now[f"k{v}"] = (f"k{v}", "d", "public", text)
        segments.append(spark, path, v, make([now[f"k{v}"]]), make([now.pop(ends)]) if ends else None)
    segments.compact(spark, path, f"{path}-one", 4)
    cells = spark.read.parquet(f"{path}-one/cells")
    assert cells.select("cell").distinct().count() == 1 and cells.count() == 3
    queries = spark.createDataFrame([(1, "a c")], "query_id int, query string")
    want = shown(retrieve.bm25_topk(index.token_table(make(list(now.values())), "key", "text"), queries, 9))
    assert shown(segments.Search(spark, f"{path}-one", queries, 9, 1).filled()) == shown(segments.Search(spark, path, queries, 9, 4).filled()) == want


def test_blocks_keep_their_rows():
    rows = pa.table({"d": ["x", "x", None, None, "x"], "p": pa.array([0, 0, 0, 1, 1], pa.int32()), "t": ["a", "ab", "b", "ü", ""], "n": pa.array([[1], [], None, [2, 3], [4]], pa.list_(pa.int16()))})
    blocks = packed.pack(rows, ["d", "p"])
    assert blocks.column("d").to_pylist() == ["x", None, None, "x"] and blocks.column("p").to_pylist() == [0, 0, 1, 1]
    read = pa.concat_tables([packed.pq.read_table(pa.BufferReader(b.as_buffer())) for b in blocks.column("block")])
    assert read.to_pylist() == rows.drop_columns(["d", "p"]).to_pylist()
    assert packed.runs(rows, ["d"]).tolist() == [0, 2, 4] and packed.runs(rows.slice(0, 0), ["d"]).tolist() == []
    order, cell = segments._numbered(pa.record_batch({"department": ["a"] * 6 + ["b"] * 2, "access_level": ["l"] * 8}), np.array([9, 1, 1, 1, 1, 9, 3, 3]), 4)
    assert order.tolist() == [1, 2, 3, 4, 0, 5, 6, 7] and cell.tolist() == [0, 0, 0, 0, 1, 1, 2, 2]
