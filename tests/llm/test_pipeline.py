import corpus_pipeline
from millrace.llm import minhash_dedup, pii, quality_rules
from pyspark.sql import functions as F

from ..conftest import SF
from .test_duplicates import brute
from .test_packing_classifier import check_pieces
from .test_rules_urls_shards import measured


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "quality_classifier", "minhash_dedup", "pii", "best_fit_packing"]

    good = steps["quality_rules"](spark, docs, SF).cache()
    assert good.columns == docs.columns
    ids = {r["doc_id"] for r in good.collect()}
    assert all(measured(r["text"])[0] >= 50 for r in good.collect()) and ids < {r["doc_id"] for r in docs.collect()}

    scored = steps["quality_classifier"](spark, good, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert scored.columns == docs.columns
    clean = good.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert scored.join(clean, "doc_id", "left_semi").count() >= 0.95 * clean.count()

    single = steps["minhash_dedup"](spark, scored, SF).cache()
    rows = sorted(scored.collect(), key=lambda r: r["doc_id"])
    _, comp = brute([r["text"] for r in rows], 5)
    assert {r["doc_id"] for r in single.collect()} == {rows[i]["doc_id"] for i, c in enumerate(comp) if i == c}

    redacted = steps["pii"](spark, single, SF).cache()
    assert redacted.columns == docs.columns and redacted.count() == single.count()
    assert all(not pii.find_base(r["text"]) and r["n_chars"] == len(r["text"]) for r in redacted.collect())

    check_pieces(steps["best_fit_packing"](spark, redacted, SF).collect(), {r["doc_id"]: r["text"] for r in redacted.collect()})


def test_run_and_empty(spark, no_docs, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_pass_each_stage(spark, odd_docs):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd_docs, SF).collect()
    assert quality_rules.keep_good(odd_docs).columns == odd_docs.columns
    assert minhash_dedup.T == minhash_dedup.BANDS * minhash_dedup.ROWS


def test_any_column_names_pass_each_stage(spark, docs_of):
    good = [" ".join(f"word{(i * 7 + k) % 997}x{i}" for k in range(120)) for i in range(6)]
    docs = docs_of([*good, good[0], None, "", good[1] + " mail me at a.b@example.org"])
    for name in ("a.b", "_text", "failed", "key", "in", "rank", "n", "score", "file", "text.x", "_in"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    want = {r["doc_id"]: r for r in docs.collect()}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns, name
    for r in rows.collect():
        assert all(r[c] == want[r["doc_id"]][c] for c in docs.columns if c not in ("text", "n_chars")), r
    redacted = pii.redact(docs, pii.fit(docs))
    assert redacted.columns == docs.columns and "[EMAIL]" in redacted.where("doc_id = 9").first()["text"]
    assert redacted.where("text is null").count() == 1
    kept = quality_rules.keep_good(docs).collect()
    assert kept and all(r["a.b"] == f"a.b{r['doc_id']}" for r in kept)
