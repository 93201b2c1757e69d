"""Buckets: what a version writes, what it leaves, and what is read."""

from pathlib import Path

import pytest
from millrace.operators.buckets import BucketTable, bucket_of

SCHEMA = "`a.b` string, n int, text string"


def _files(path, version):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).glob(f"rows/version={version}/bucket=*/*.parquet")}


def test_only_buckets_that_are_hit_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = BucketTable.create(spark.createDataFrame([(f"k{i}", i, "x") for i in range(200)], SCHEMA), path, ["a.b"], 16)
    before = _files(path, 1)
    state = lambda upto=None: sorted((r["a.b"], r["n"], r["text"]) for r in table.read(upto).collect())
    new = spark.createDataFrame([("k1", 5, "new", 2), ("k1", 6, "old", 1), (None, 7, "null", 1), (None, 8, "null", 2)], SCHEMA + ", at int")
    hit = {r["b"] for r in new.select(bucket_of(["a.b"], 16).alias("b")).collect()}
    assert table.upsert(new, order="at") == 2
    want = sorted([(f"k{i}", i, "x") for i in range(200) if i != 1] + [("k1", 5, "new")])
    assert [r for r in table.read().collect() if r["a.b"] is None][0]["n"] == 8
    assert sorted((r["a.b"], r["n"], r["text"]) for r in table.read().collect() if r["a.b"] is not None) == want
    assert _files(path, 1) == before and len(hit) < 16
    assert {r["bucket"] for r in table.read().where("version = 2").collect()} == hit
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in _files(path, 2)} == hit
    # The last version once more gives one version; the one before is still there.
    assert table.upsert(new, order="at", version=2) == 2 and table.read().count() == 201
    assert state(1) == sorted((f"k{i}", i, "x") for i in range(200))
    # All rows of one bucket go: it is empty, not what it was.
    whole = table.read().where(f"bucket = {min(hit)}")
    left = table.read().where(f"bucket <> {min(hit)}").count()
    assert BucketTable(spark, path).delete(whole) == 3 and table.read().count() == left
    assert table.log()[min(hit)] == (3, 0)


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    table = BucketTable.create(empty, f"{tmp_path}/e", ["a.b", "n"], 4)
    assert table.read().count() == 0
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", None, None)], SCHEMA)
    table.upsert(rows)
    assert table.read().count() == 3
    assert table.upsert(empty) == 2 and table.delete(empty) == 2
    assert table.upsert(rows.where("n is null")) == 3
    assert table.read().count() == 3 and table.version() == 3
    table.delete(rows.where("n = 1"))
    assert [(r["n"], r["text"]) for r in table.read().collect()] == [(None, None)]
    with pytest.raises(ValueError, match="bucket"):
        BucketTable.create(spark.createDataFrame([(1,)], "bucket int"), f"{tmp_path}/b", ["bucket"])
