"""Access, indexing, retrieval, the answer loop, audit and streaming."""

import json

import pytest
from millrace.config import Agent
from millrace.operators import access, agent, audit, index, models, reports, retrieve
from millrace.streaming import ingest
from pyspark.sql import functions as F


def test_where(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", "x")], "id int, p string, q string")
    ids = lambda w: [r["id"] for r in df.where(access.where_column(w)).orderBy("id").collect()]
    assert ids({"p": "a"}) == [1] and ids({"p": None}) == [2] and ids({"p": {"$in": ["a", "b"]}}) == [1, 3] and ids({"p": {"$in": [None, "a"]}}) == [1, 2]
    assert ids({"$and": [{"q": "x"}, {"p": "b"}], "p": "a"}) == [3] and ids({}) == ids(None) == [1, 2, 3] and ids({"p": "a", "q": "y"}) == [] and ids({"p": {"$in": []}}) == []
    for bad in ({"$or": []}, {"p": {"$ne": "a"}}):
        with pytest.raises(ValueError):
            access.where_column(bad)


def test_access(spark):
    rows = spark.createDataFrame([(1, "hr", "public"), (2, "general", "internal"), (3, "hr", "confidential"), (4, "it", "public"), (5, "hr", "odd"), (6, "hr", None)], "id int, department string, access_level string")
    ids = lambda *who: {r["id"] for r in rows.where(access.where_column(access.access_filter(*who))).collect()}
    assert ids("hr", "confidential") == {1, 2, 3} and ids("hr", "internal") == {1, 2} and ids("hr", "???") == {1}
    readers = spark.createDataFrame([("a", "hr", "confidential"), ("b", "general", "public")], "who string, department string, clearance string")
    assert {(r["who"], r["id"]) for r in access.readable_pairs(readers, rows).collect()} == {("a", 1), ("a", 2), ("a", 3)}
    one = rows.select("id", access.readable(F.lit("hr"), F.lit("internal"), F.col("department"), F.col("access_level")).alias("ok")).where("ok")
    assert {r["id"] for r in one.collect()} == {1, 2}


TEXTS = [("d1", "alpha beta beta"), ("d2", "beta gamma"), ("d3", "delta"), ("d4", "")]


def bm25(spark, query, **more):
    table = index.token_table(spark.createDataFrame(TEXTS, "k string, t string"), "k", "t")
    return [(r["key"], r["score"]) for r in retrieve.bm25_topk(table, spark.createDataFrame([(1, query)], "query_id int, query string"), 3, **more).orderBy("rank").collect()]


def test_bm25(spark):
    hits = bm25(spark, "gamma")
    assert hits[0][0] == "d2" and hits[0][1] > 0 and hits[1:] == [("d1", 0.0), ("d3", 0.0)]
    assert bm25(spark, "gamma gamma")[0][1] == pytest.approx(2 * hits[0][1], abs=1e-5)
    assert bm25(spark, "zzz") == [("d1", 0.0), ("d2", 0.0), ("d3", 0.0)] and bm25(spark, "...") == [] and bm25(spark, "zzz", zero_fill=False) == []
    import math

    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in {"alpha": 1, "beta": 2, "gamma": 1, "delta": 1}.items()}
    want = raw["gamma"] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.5))
    assert hits[0][1] == pytest.approx(want, abs=1e-5)
    with pytest.raises(ValueError):
        retrieve.top_k(spark.range(1).withColumn("query_id", F.lit(1)), 0, [F.col("id")])


def ranked(spark, rows):
    return spark.createDataFrame([(1, k, i + 1, float(s)) for i, (k, s) in enumerate(rows)], "query_id int, key string, rank int, score double")


def test_fusion(spark):
    out = retrieve.rrf(ranked(spark, [("a", 0.9), ("b", 0.8)]), ranked(spark, [("c", 7), ("b", 5)])).orderBy("rank").collect()
    assert [r["key"] for r in out] == ["b", "a", "c"]
    assert out[0]["score"] == pytest.approx(2 / 62, abs=1e-9) and [tuple(f) for f in out[0]["fusion"]] == [("vector", 2, 0.8), ("bm25", 2, 5.0)]
    lone = retrieve.rrf(ranked(spark, []), ranked(spark, [("x", 1)])).collect()
    assert [r["key"] for r in lone] == ["x"]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "red fox", "k1", "a dog", 1, 0.5), (1, "red fox", "k2", "the red fox", 2, 0.4), (1, "red fox", "k3", "a cat", 3, 0.3), (2, " RED Fox", "k2", "the red fox", 1, 0.2)], "query_id int, query string, key string, content string, rank int, score double")
    out = [(r["query_id"], r["key"], r["score"], r["hybrid_score"]) for r in retrieve.rerank(hits, k=2).orderBy("query_id", "rank").collect()]
    assert out == [(1, "k2", 1.0, 0.4), (1, "k1", 0.0, 0.5), (2, "k2", 1.0, 0.2)]


def test_embedder_and_cosine(spark):
    embed = retrieve.hash_embedder(32)
    df = spark.createDataFrame([("a", "red fox"), ("b", "fox red"), ("c", "")], "key string, t string").select("key", embed("t").alias("v"))
    got = retrieve.vector_topk(df, df.where("key = 'a'").select(F.lit(1).alias("query_id"), F.col("v").alias("q")), 2).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == [("a", 1.0), ("b", 1.0)]


def test_maintenance(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("twin", "h2"), ("c", "h3")], "source_path string, file_hash string")
    now = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("twin", "h2"), ("d", "h4")], "source_path string, file_hash string")
    changes = index.classify(now, old)
    assert {r["source_path"]: r["status"] for r in changes.collect()} == {"a": "unchanged", "b": "changed", "twin": "unchanged", "c": "deleted", "d": "new"}
    assert index.run_summary(changes).first().asDict() == {"total": 4, "added": 2, "skipped": 2, "deleted": 1}
    chunks = old.withColumn("chunk_id", F.concat("file_hash", F.lit("_0000")))
    added = now.where("source_path in ('b', 'd')").withColumn("chunk_id", F.concat("file_hash", F.lit("_0000")))
    after = index.apply_changes(chunks, changes, added)
    assert {(r["source_path"], r["file_hash"]) for r in after.collect()} == {("a", "h1"), ("twin", "h2"), ("b", "h9"), ("d", "h4")}
    again = index.classify(now, index.next_manifest(now, after))
    assert {r["status"] for r in again.collect()} == {"unchanged"}
    assert {r["chunk_count"] for r in index.next_manifest(now, after.where("source_path = 'a'")).collect()} == {0, 1}
    up = index.upsert(chunks.select("chunk_id", "source_path"), spark.createDataFrame([("h1_0000", "z"), ("h1_0000", "y")], "chunk_id string, source_path string"), order="source_path")
    assert sorted(r["source_path"] for r in up.where("chunk_id = 'h1_0000'").collect()) == ["z"]


def value(spark, column):
    return spark.range(1).select(column.alias("r")).first()["r"]


def turns(*rows):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in rows]) if rows else F.array().cast(agent.TURNS)


def test_followup(spark):
    for q, want in (("short one", True), ("tell me everything about labour law today", False), ("tell me everything about it right now please", True), ("And tell me everything about labour law today", True), ("explain to me what about labour law today", False), ("", True)):
        assert value(spark, agent.is_followup(F.lit(q))) is want, q


def test_gates(spark):
    h = turns(("user", "Old question here"), ("assistant", "x"))
    gate = lambda q, new: value(spark, agent.rewrite_gate(F.lit(q), F.lit(new), h))
    assert gate("what of it", "What of it") == "verbatim" and gate("what of it", "abc") == "empty" and gate("what of it", "old question here") == "collapsed"
    assert gate("what of it", "totally new words stand here") == "drifted" and gate("what of it", "new words here") is None and gate("what of it", "what of the law of labour") is None
    assert value(spark, agent.forced_join(F.lit("q"), h)) == "q (avvalgi savol: Old question here)" and value(spark, agent.forced_join(F.lit("q"), turns())) == "q"


def test_history(spark):
    h = turns(*[("user", f"t{i}") for i in range(6)], ("assistant", "y" * 500))
    assert value(spark, agent.history_text(h)) == "USER: t3\nUSER: t4\nUSER: t5\nASSISTANT: " + "y" * 400
    assert value(spark, agent.history_text(turns())) == agent.NO_TURNS and value(spark, agent.last_user(turns())) == ""


def test_bands(spark):
    nums = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert [value(spark, agent.band(F.lit(x))) for x in (0.5, 0.49, 0.1, 0.11)] == ["accept", "grade", "reject", "grade"]
    assert value(spark, agent.upper_median(nums(0.9, 0.1, 0.5, 0.6))) == 0.5 and value(spark, agent.upper_median(nums(1, 2, 3))) == 2
    assert value(spark, agent.high_confidence(nums(0.9, 0.6))) is True and value(spark, agent.high_confidence(nums(0.9, 0.59))) is False
    assert value(spark, agent.high_confidence(nums(0.95))) is False and value(spark, agent.high_confidence(F.array().cast("array<double>"))) is False


def test_verdicts(spark):
    said = lambda **x: json.dumps(x)
    read = lambda reply: value(spark, agent.yes_no(F.lit(reply), "relevant"))
    good = said(relevant="yes", reason="r")
    assert read(good) == "yes" and read(f"```json\n{good}\n```") == "yes" and read(f"{good} {good}") is None and read("none") is None
    assert read(said(relevant="yes", reason="x" * 301)) is None and read(said(relevant="maybe", reason="r")) is None and read(said(relevant="no", reason="x" * 300)) == "no" and read("{broken}") is None and read(said(relevant="yes")) is None
    assert value(spark, agent.phrase(F.lit(said(rewritten="x" * 501)), "rewritten")) is None and value(spark, agent.phrase(F.lit(said(rewritten="q")), "rewritten")) == "q"
    second = agent.twice(lambda k: F.lit(["bad", good][k]), lambda r: agent.yes_no(r, "relevant"), F.lit("no"))
    assert value(spark, second) == "yes"


class Scripted(agent.Models):
    """Replies by the first letter of the query."""

    def grounded(self, answer, passages, attempt):
        return F.when(F.col("original_query").startswith("u"), '{"grounded": "no", "reason": "r"}').otherwise('{"grounded": "yes", "reason": "r"}')

    def addresses(self, query, answer, attempt):
        return F.when(query.startswith("n"), '{"addresses": "no", "reason": "r"}').otherwise('{"addresses": "yes", "reason": "r"}')


def loop(spark, rows, scores, caps=None):
    asked = spark.createDataFrame(rows, f"query_id string, query string, history {agent.TURNS}")
    passage = [F.struct(F.lit(f"c{i}").alias("chunk_id"), F.lit("words of labour law").alias("content"), F.lit("f").alias("filename"), F.lit(1).alias("page"), F.lit("").alias("article_label"), F.lit("v1").alias("doc_version"), F.lit(s).alias("score")) for i, s in enumerate(scores)]
    found = F.array(*passage) if passage else F.array().cast(f"array<{agent.PASSAGE}>")
    return {r["query_id"]: r for r in agent.answer_batch(asked, lambda q: q.select("query_id", found.alias("passages")), Scripted(), caps).collect()}


def test_loop(spark):
    out = loop(spark, [("ok", "plain words", []), ("bad", "unbelievable words", []), ("not", "never right words", []), ("notctx", "never", [("user", "labour law")])], [0.6, 0.3, 0.05])
    assert (out["ok"]["final_reason"], out["ok"]["generation_count"], out["ok"]["rewrite_count"]) == ("ok", 1, 0)
    assert out["ok"]["answer"].endswith("[1]") and any("2 considered" in n or "3 considered, 2 auto, 1 graded" in n for n in out["ok"]["notes"])
    assert (out["bad"]["final_reason"], out["bad"]["generation_count"]) == ("gen_limit", 3)
    assert (out["not"]["final_reason"], out["not"]["rewrite_count"], out["not"]["generation_count"]) == ("ok", 2, 3)
    assert (out["notctx"]["final_reason"], out["notctx"]["answer"]) == ("contextualize_failed", agent.REPHRASE)
    assert max(r["steps"] for r in out.values()) <= 23
    sure = loop(spark, [("ok", "plain words", [])], [0.95, 0.9])["ok"]
    assert sure["high_confidence"] and sure["final_reason"] == "ok" and not sure["hallucination_ok"]


def test_loop_without_passages(spark):
    out = loop(spark, [("none", "what is there to know about labour law", []), ("follow", "it", [("user", "labour law")])], [])
    assert (out["none"]["final_reason"], out["none"]["answer"], out["none"]["rewrite_count"]) == ("no_docs", agent.NOT_FOUND, 2)
    assert out["follow"]["final_reason"] == "contextualize_failed"
    earlier = loop(spark, [("kept", "never right words", [])], [0.6], Agent(min_relevant_docs=2))["kept"]
    assert earlier["final_reason"] == "no_docs"


def test_endpoint(spark):
    # Failing, slow and senseless replies are asked again, then the loop's defaults count; equal prompts are asked once.
    def endpoint():
        seen = {}

        def call(prompt, settings):
            n = seen[prompt] = seen.get(prompt, 0) + 1
            if "wordless" in prompt:
                raise OSError("down")
            if "Reply with JSON" not in prompt:
                assert settings == models.GENERATOR
                return "thirty days [1]"
            assert settings == models.GRADER
            field = next(f for f in ("standalone_query", "rewritten", "relevant", "grounded", "addresses") if f'{{"{f}"' in prompt)
            if n == 1 and field == "relevant":
                return "no object here"
            return '{"%s": "%s", "reason": "so"}' % (field, "and theirs, the leave of teachers" if field in ("standalone_query", "rewritten") else "yes")

        return call

    own = models.EndpointModels(endpoint=endpoint)
    queries = spark.createDataFrame([("a", "how long is the leave of teachers this year", []), ("b", "and theirs", [("user", "leave of teachers")]), ("c", "a wordless question that nothing can ever answer", [])], f"query_id string, query string, history {agent.TURNS}")
    passage = F.array(F.struct(F.lit("c0").alias("chunk_id"), F.lit("leave lasts thirty days").alias("content"), F.lit("f").alias("filename"), F.lit(1).alias("page"), F.lit("").alias("article_label"), F.lit("v1").alias("doc_version"), F.lit(0.3).alias("score")))
    out = {r["query_id"]: r for r in agent.answer_batch(queries, lambda q: q.select("query_id", passage.alias("passages")), own).collect()}
    assert (out["a"]["final_reason"], out["a"]["answer"]) == ("ok", "thirty days [1]") and out["b"]["contextualized_query"] == "and theirs, the leave of teachers"
    assert out["c"]["final_reason"] == "no_docs"
    notes = reports.trace_report(spark.createDataFrame([(r["query_id"], r["final_reason"], r["steps"], r["rewrite_count"], r["generation_count"], r["relevant"], r["notes"]) for r in out.values()], f"query_id string, final_reason string, steps int, rewrite_count int, generation_count int, relevant array<{agent.PASSAGE}>, notes array<string>"))
    assert notes.where("query_id = 'a' and node = 'grade_docs'").count() == 1
    assert models.usable('x {"a": "b"} y', "a") and not models.usable('{"a": 1}', "a") and not models.usable("{}", "a") and not models.usable(None, None)
    slow = models.asked(lambda: lambda p, s: __import__("time").sleep(5) or "late", {}, None, 1, 0.2, 2)
    assert spark.createDataFrame([("p",), (None,)], "p string").select(slow(F.col("p")).alias("r")).where("r is not null").count() == 0


def test_reports_of_stages(spark):
    rows = spark.createDataFrame([(1, "k", 1.0, 1), (1, "l", 0.5, 2)], "query_id int, key string, score double, rank int")
    got = reports.staged({"one": lambda _: rows, "two": lambda done: done["one"].where("rank = 1")}, k=2).collect()
    assert sorted((r["stage"], r["key"]) for r in got) == [("one", "k"), ("one", "l"), ("two", "k")] and all(r["seconds"] > 0 for r in got)
    blocks = spark.createDataFrame([("d", "text", "abc", 2), ("d", "table", "x", None), ("e", "text", "", None)], "doc string, kind string, content string, page int")
    assert sorted(map(tuple, reports.block_report(blocks, "doc").collect())) == [("d", 2, 1, 1, 4, 3, 2), ("e", 1, 1, 0, 0, 0, 1)]


def test_audit(spark, tmp_path):
    row = spark.createDataFrame([("hr", "public", "sav​ol?", "javob", ["t"])], "department string, clearance string, query string, answer string, trace array<string>")
    passage = F.struct(*[F.lit(v).alias(k) for k, v in {"filename": "f", "page": 1, "article_label": "", "chunk_id": "c", "doc_version": "v1", "content": "secret"}.items()])
    made = row.withColumn("relevant", F.array(passage))
    audit.append(audit.audit_rows(made), f"{tmp_path}/log")
    audit.append(audit.audit_rows(made, F.lit(True)), f"{tmp_path}/log")
    rows = spark.read.json(f"{tmp_path}/log")
    assert rows.count() == 2 and "secret" not in str(rows.collect()) and rows.first()["sources"][0]["chunk_id"] == "c"
    assert audit.latest_flags(rows, "query").first()["flagged"] is True


def test_reports(spark):
    rows = spark.createDataFrame([("d", "text", "a", 50), ("d", "table", "", 150), ("d", "text", None, 301), ("e", "text", "a", 10)], "p string, kind string, label string, n int")
    r = reports.size_report(rows, ["p"], F.col("n"), kind="kind", label="label").where("p = 'd'").first()
    assert (r["n"], r["min_size"], r["avg_size"], r["max_size"], r["tiny"], r["small"], r["full"], r["n_text"], r["n_table"], r["labelled"], r["named"]) == (3, 50, 167, 301, 1, 1, 1, 2, 1, 2, 1)
    assert [x["label"] for x in reports.top_labels(rows, "label", "n").collect()] == ["a", ""]
    assert [x["department"] for x in reports.departments(rows, "p").collect()] == ["d", "e"] and [x["department"] for x in reports.departments(rows.where("n > 999"), "p").collect()] == ["general"]
    assert [x["id"] for x in reports.stride_sample(spark.range(25).withColumn("g", F.lit(1)), "g", ["id"]).orderBy("id").collect()] == list(range(0, 20, 2))


def test_stream(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_text("one")
    (raw / "x.csv").write_text("no")
    seen = []

    def changed(fresh, changes):
        seen.extend((r["source_path"].rsplit("/", 1)[1], r["status"]) for r in fresh.collect())

    for _ in range(2):
        ingest.ingest_files(spark, str(raw), f"{tmp_path}/manifest", f"{tmp_path}/cp", changed).awaitTermination()
    (raw / "b.txt").write_text("two")
    ingest.ingest_files(spark, str(raw), f"{tmp_path}/manifest", f"{tmp_path}/cp", changed).awaitTermination()
    assert seen == [("a.txt", "new"), ("b.txt", "new")]
    stream = spark.readStream.schema("v int").json(str(tmp_path / "in")) if (tmp_path / "in").mkdir() is None else None
    (tmp_path / "in/1.json").write_text('{"v": 1}')
    ingest.audit_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").first()["v"] == 1


def test_calls_that_hang_keep_no_place():
    import threading
    import time

    from millrace.operators.models import Calls

    stop, seen, lock = threading.Event(), [], threading.Lock()

    def call(text, settings):
        with lock:
            seen.append(text)
        if text.startswith("hang"):
            stop.wait(20)
        if text.startswith("once") and seen.count(text) == 1:
            raise OSError("down")
        return text.upper()

    began = time.monotonic()
    asked = ["hang 1", "hang 2", "a", "b", "once", "c"]
    got = Calls(call, {}, None, attempts=2, seconds=0.4, parallel=2).replies(asked)
    stop.set()
    assert got == {"hang 1": None, "hang 2": None, "a": "A", "b": "B", "once": "ONCE", "c": "C"}
    assert time.monotonic() - began < 5 and seen.count("hang 1") == 2 and seen.count("a") == 1
    assert Calls(call, {}, None, 1, 1.0, 2).replies([]) == {}


def test_score_cache_drops_the_oldest(spark, tmp_path):
    path, held, n = str(tmp_path / "scores"), [], 0
    for size in (5, 4, 1, 1, 7, 40, 3, 0):
        rows = [(1, "Q ", f"k{n + i:03}", f"c{n + i}", i, 0.0) for i in range(size)]
        hits = spark.createDataFrame(rows + [(1, "q", k, "x", 99, 0.0) for k in held[-2:]], "query_id int, query string, key string, content string, rank int, score double")
        retrieve.rerank_stored(hits, path, most=10, drop=4).collect()
        for r in rows:
            if len(held) >= 10:
                held = held[4:]
            held.append(r[2])
        n += size
        assert sorted(r["key"] for r in retrieve.cached_scores(spark, path).collect()) == held
    retrieve.pruned_scores(spark, path, path + "-pruned")
    assert sorted(r["key"] for r in retrieve.cached_scores(spark, path + "-pruned").collect()) == held
    assert spark.read.parquet(path + "-pruned").count() == len(held) < spark.read.parquet(path).count()


def test_vector_index_finds_what_a_scan_finds(spark, tmp_path):
    import math
    import random

    from millrace.operators import vector_index

    rnd = random.Random(41)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(k, [c + rnd.gauss(0, 0.15) for c in centres[k % 12]], k % 4) for k in range(900)]
    rows += [(900, [0.0] * 8, 0), (901, None, 1), (902, [math.nan] + [1.0] * 7, 1), (903, rows[5][1], 2), (904, rows[5][1], 1)]
    vectors = spark.createDataFrame(rows, "key long, v array<float>, part int")
    queries = spark.createDataFrame([(k, rows[k][1]) for k in (5, 17, 40)] + [(900, [0.0] * 8), (77, [rnd.gauss(0, 1) for _ in range(8)])], "query_id int, q array<float>")
    path = str(tmp_path / "vectors")
    vector_index.write(vectors, path, list_rows=40)
    for allowed in (None, F.col("part") == 1):
        search = vector_index.Search(spark, path, queries, 10, allowed)
        shown = [sorted((r["query_id"], r["rank"], r["key"], str(r["score"])) for r in x.collect()) for x in (search.hits(), retrieve.vector_topk(vectors, queries, 10, allowed))]
        assert shown[0] == shown[1] and len(shown[0]) == 50
        seen = {r["query_id"]: (r["lists"], r["read"]) for r in search.report().collect()}
        assert seen[5][1] < seen[5][0] / 2 and seen[900][1] == seen[900][0] > 15
    # A filter that leaves fewer than k rows opens all lists.
    few = vector_index.Search(spark, path, queries.limit(1), 10, F.col("key") < 3)
    assert few.hits().count() == 3
    vector_index.write(vectors.limit(0), path + "-none")
    assert vector_index.Search(spark, path + "-none", queries, 3).hits().count() == 0


def test_batch_search_in_blocks_and_groups(spark, monkeypatch):
    # Null, zero, not finite and shorter vectors, equal scores, several blocks and groups: the rows of the scan by expressions.
    monkeypatch.setattr(retrieve, "QUERIES", 2)
    monkeypatch.setattr(retrieve, "ROWS", 3)
    monkeypatch.setattr(retrieve, "GROUP_QUERIES", 3)
    odd = [None, [], [0.0, 0.0], [1.0, float("nan")], [float("inf"), 1.0], [1.0], [None, 1.0]]
    rows = [(k, odd[k] if k < len(odd) else [float(k % 5), float(k % 3 - 1)]) for k in range(40)]
    vectors = spark.createDataFrame([*rows, (None, [1.0, 1.0])], "key long, v array<double>")
    queries = vectors.where("key < 12").select(F.concat(F.lit("q"), "key").alias("query_id"), F.col("v").alias("q"))
    got, want = (sorted(map(str, f.collect())) for f in (retrieve.vector_topk(vectors, queries, 7), retrieve.vector_topk(vectors.withColumn("one", F.lit(1)), queries.withColumn("one", F.lit(1)), 7, on=["one"])))
    assert got == want and len(got) == 12 * 7


def test_batch_search_without_filling(spark, monkeypatch):
    # Words whose weight is 0 or less still make a hit; the rest of a batch's chunks are left out.
    monkeypatch.setattr(retrieve, "GROUP_WORDS", 4)
    monkeypatch.setattr(retrieve, "ROWS", 2)
    table = spark.createDataFrame([(k, ["a"] * (1 + k % 3) + (["b"] if k % 2 else []) + ([f"w{k}"] if k > 5 else [])) for k in range(8)] + [(8, [])], "key long, tokens array<string>")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(("a", "b b", "a b w7", "none", "w6 w6 a", "..."))], "query_id string, query string")
    got, want = (sorted(map(str, f(table, queries, 4, zero_fill=False).select("query_id", "key", "score", "rank").collect())) for f in (retrieve.bm25_topk_long, retrieve.bm25_topk))
    assert got == want and {r[14:16] for r in got} >= {"q0", "q1"}

def test_vector_index_makes_no_pairs(spark, tmp_path, monkeypatch):
    # Copies in more rows than there are lists, keys that are texts, blocks and groups of a few; files are ranges, whatever the number of lists.
    import random

    from millrace.operators import vector_index

    for name, n in (("QUERIES", 3), ("ROWS", 4), ("GROUP_QUERIES", 5)):
        monkeypatch.setattr(retrieve, name, n)
    monkeypatch.setattr(vector_index, "FILE", 100)
    rnd = random.Random(43)
    few = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(20)]
    rows = [(f"k{k:03d}", few[0] if k % 3 == 0 else few[k % 20], k % 9) for k in range(400)] + [(None, few[1], 1)]
    vectors = spark.createDataFrame(rows, "key string, v array<float>, part int")
    queries = spark.createDataFrame([(k, few[k]) for k in range(11)] + [(11, None), (12, [1.0])], "query_id int, q array<float>")
    path = str(tmp_path / "vectors")
    vector_index.write(vectors, path, list_rows=10)
    assert len(list((tmp_path / "vectors" / "rows").rglob("*.parquet"))) <= 6
    for allowed in (None, F.col("part") == 1, F.col("key") == "k009"):
        search = vector_index.Search(spark, path, queries, 7, allowed)
        shown = [sorted((r["query_id"], r["rank"], str(r["key"]), str(r["score"])) for r in x.collect()) for x in (search.hits(), retrieve.vector_topk(vectors, queries, 7, allowed))]
        assert shown[0] == shown[1] and len(shown[0]) == 13 * (1 if len(shown[0]) < 50 else 7)
        nodes = search.hits()._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in nodes and "MapInArrow" in nodes
    assert search.report().count() == 13
