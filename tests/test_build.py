"""A folder indexed, updated, searched and asked."""

import random

from millrace.plans import build
from millrace.streaming import ingest
from pyspark.sql import functions as F

from .test_segments import shuffled

LONG = " This sentence makes the passage long enough to be kept."


def test_index_follows_the_folder(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "index")
    (raw / "hr").mkdir(parents=True)
    (raw / "a.txt").write_text("Article 1\nVacation lasts thirty days." + LONG + "\nArticle 2\nSalaries are paid monthly." + LONG)
    (raw / "hr/b.txt").write_text("Interviews take place on Mondays." + LONG)
    (raw / "hr/bad.docx").write_bytes(b"no zip")
    run = lambda **more: build.build_index(spark, str(raw), out, access_level="public", **more).first().asDict()
    paths = lambda: sorted((r["source_path"].rsplit("/", 1)[1], r["chunk_id"][-4:], r["department"]) for r in build.chunks(spark, out).collect())

    assert run() == {"total": 3, "added": 3, "skipped": 0, "deleted": 0, "failed": 1}
    first = [("a.txt", "0000", "general"), ("a.txt", "0001", "general"), ("b.txt", "0000", "hr")]
    assert paths() == first
    assert run() == {"total": 3, "added": 1, "skipped": 2, "deleted": 0, "failed": 1}  # the unreadable file is tried again
    assert paths() == first

    (raw / "a.txt").write_text("Vacation lasts forty days now." + LONG)
    (raw / "hr/b.txt").unlink()
    (raw / "hr/bad.docx").unlink()
    (raw / "c.txt").write_text("x")
    assert run() == {"total": 2, "added": 2, "skipped": 0, "deleted": 1, "failed": 0}
    assert paths() == [("a.txt", "0000", "general")]
    assert {r["chunk_count"] for r in build.manifest(spark, out).collect()} == {0, 1}
    assert build.stats(spark, out).first().asDict() == {"files": 2, "chunks": 1, "vectors": 1}
    assert run(rebuild=True)["added"] == 2 and paths() == [("a.txt", "0000", "general")]

    asked = spark.createDataFrame([("q1", "How long does vacation last", "it", "public"), ("q2", "vacation", "hr", "nonsense")], "query_id string, query string, department string, clearance string")
    hits = build.search(spark, out, asked).orderBy("query_id").collect()
    assert [(r["query_id"], r["rank"], len(r["fusion"])) for r in hits] == [("q1", 1, 2), ("q2", 1, 2)]
    # The segments score as the chunks do, over all versions.
    words = build.index.token_table(build._keyed(build.chunks(spark, out)), "key", "content")
    stored = build.segments.Search(spark, build._lexical(out), asked.select("query_id", "query"), 20, build.last_version(spark, out))
    shown = [sorted((r["query_id"], r["key"], r["score"]) for r in x.collect()) for x in (stored.hits(), build.retrieve.bm25_scores(words, asked))]
    assert shown[0] == shown[1] and len(shown[0]) == 2
    answered = build.answer(spark, out, asked.where("query_id = 'q1'")).first()
    assert answered["final_reason"] == "ok" and "forty days" in answered["answer"]
    closed = build.chunks(spark, out).withColumn("access_level", F.lit("internal"))
    assert closed.count() == 1


def test_a_replayed_batch_is_one_version(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "index")
    (raw / "hr").mkdir(parents=True)
    (raw / "a.txt").write_text("Vacation lasts thirty days." + LONG)
    (raw / "hr/b.txt").write_text("Interviews take place on Mondays." + LONG)
    go = lambda: ingest.index_stream(spark, str(raw), out, f"{tmp_path}/cp", access_level="public").awaitTermination()
    asked = spark.createDataFrame([(1, "interviews"), (2, "vacation"), (3, "passage")], "query_id int, query string")

    def state():
        chunks = sorted((r["source_path"].rsplit("/", 1)[1], r["content"]) for r in build.chunks(spark, out).collect())
        last = build.last_version(spark, out)
        hits = build.segments.Search(spark, build._lexical(out), asked, 9, last).hits().collect()
        return last, chunks, sorted((r["query_id"], r["key"].rsplit("/", 1)[1], r["score"]) for r in hits)

    go()
    assert state()[0] == 1 and len(state()[1]) == 2
    (raw / "a.txt").unlink()
    (raw / "c.txt").write_text("Salaries are paid monthly, vacation or not." + LONG)
    go()
    last, chunks, hits = state()
    assert last == 2 and [c[0] for c in chunks] == ["b.txt", "c.txt"] and [h[0] for h in hits] == [1, 2, 3, 3]
    # The second batch once more, as after a driver that was lost before it noted the end of the batch.
    rows = spark.read.format("binaryFile").load(f"{raw}/c.txt")
    ingest.index_batch(spark, str(raw), out, access_level="public")(rows, 1)
    assert state() == (last, chunks, hits)
    # The index is the one that a build from nothing makes.
    build.build_index(spark, str(raw), f"{out}-anew", access_level="public")
    assert chunks == sorted((r["source_path"].rsplit("/", 1)[1], r["content"]) for r in build.chunks(spark, f"{out}-anew").collect())

    seen = []
    run = ingest.ingest_batch(spark, f"{tmp_path}/manifest", lambda fresh, changes: seen.append(fresh.count()))
    for _ in range(2):
        run(rows, 0)
    run(rows, 1)
    assert seen == [1, 1, 0] and ingest.latest_manifest(spark, f"{tmp_path}/manifest").count() == 1
    assert spark.read.parquet(f"{tmp_path}/manifest").count() == 1


def test_only_files_that_changed_are_opened(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", str(tmp_path / "index")
    (raw / "hr/deep").mkdir(parents=True)
    (raw / "_hidden").mkdir()
    for at in ("a.txt", "hr/b b.txt", "hr/deep/c%20.TXT", "_hidden/d.txt"):
        (raw / at).write_text(at + LONG)
    asked = []
    whole = build.files.read
    monkeypatch.setattr(build.files, "read", lambda listed, root: asked.append(sorted(r["source_path"].rsplit("/", 1)[1] for r in listed.collect())) or whole(listed, root))
    run = lambda **more: build.build_index(spark, f"file://{raw}", out, **more).first().asDict()
    assert run()["added"] == 3
    (raw / "a.txt").write_text("a.txt" + LONG)  # another time, the same bytes
    (raw / "hr/b b.txt").write_text("other" + LONG)
    assert run() == {"total": 3, "added": 1, "skipped": 2, "deleted": 0, "failed": 0}
    assert {r["department"] for r in build.chunks(spark, out).collect()} == {"general", "hr"}
    assert run()["skipped"] == 3
    assert asked == [["a.txt", "b b.txt", "c%20.TXT"], ["a.txt", "b b.txt"], []]
    assert build.stats(spark, out).first().asDict() == {"files": 3, "chunks": 3, "vectors": 3}


def test_a_file_that_cannot_be_opened_is_a_row(spark, tmp_path):
    listed = spark.createDataFrame([(f"file:{tmp_path}/gone.txt", 3, 1)], "source_path string, length long, modified long")
    row = build.files.load(build.files.read(listed, str(tmp_path))).first()
    assert row["error"].startswith("OSError") and row["blocks"] == [] and row["file_hash"] == ""
    assert build.files.listing(spark, str(tmp_path)).count() == 0 and build.files.scan(spark, str(tmp_path)).count() == 0


def test_a_build_moves_few_times_its_texts(spark, tmp_path):
    rnd, raw = random.Random(5), tmp_path / "raw"
    texts = [" ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(1500)) for _ in range(40)]
    for i, text in enumerate(texts):
        (raw / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (raw / f"d{i % 3}/{i}.txt").write_text(text)
    last = shuffled(spark, -1)[1]
    build.build_index(spark, str(raw), str(tmp_path / "index"))
    moved, _ = shuffled(spark, last)
    # Read, cut into chunks and numbered, each time with the texts, and once as postings.
    assert 0 < moved < 3.5 * sum(map(len, texts)), moved / sum(map(len, texts))
    rows = build.chunks(spark, str(tmp_path / "index"))
    assert rows.count() > 40 and rows.where("token_estimate is null or content is null").count() == 0
