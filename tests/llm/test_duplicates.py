import os
import random
import re

import numpy as np
import pyarrow as pa
from millrace.llm import embedding_dedup, minhash_dedup
from millrace.llm.common import written
from millrace.llm.components import components
from millrace.llm.queries import QUERIES

from pyspark.sql import functions as F

from ..conftest import SF


def groups(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(10)
    links = [(i, i + 1) for i in range(0, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(950, 950)] + [(1000, 1000 + i) for i in range(300)]
    rng.shuffle(links)
    want = groups(1400, links)
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect())
    assert all(got.get(i, i) == want[i] for i in range(1400))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(texts, size):
    sets = [shingle_set(t, size) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return sets, groups(len(texts), links)


def copies(rng, n):
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 12, 60, 150]))] for _ in range(12)]
    texts = []
    for _ in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.3:
            own = own[: -1 - rng.randrange(3)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in own))
    return texts


def test_near_duplicates_are_those_of_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    texts = copies(random.Random(11), 500) + ["", None, "one", "ONE", "  ", "two words", "Two  Words"]
    for size in (2, 5):
        sets, want = brute(texts, size)
        rows = minhash_dedup.near_duplicates(docs_of(texts).repartition(5), size).collect()
        got = {r["doc_id"]: r for r in rows}
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(12)
    for n in (1, 3, 40, 400):
        agree, true = [], []
        for _ in range(60):
            pool = rng.integers(1, 2**63, 2 * n + 2, dtype=np.uint64)
            k = int(rng.integers(0, n + 1))
            x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[:k], pool[n : 2 * n - k + 1]]))
            sx, sy = minhash_dedup.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x), len(x) + len(y)]))[[0, 2]]
            assert (sx != minhash_dedup._EMPTY).all()
            agree.append((sx == sy).mean())
            true.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(agree) - np.mean(true)) < 0.02


def test_sets_are_those_of_single_texts():
    texts = [*copies(random.Random(16), 40), None, "", " \t", "a", " a b", "A B", "é É x", "x" * 9]
    for size in (1, 2, 5):
        s, at = minhash_dedup.shingle_sets(pa.array(texts, pa.string()), size)
        sets = [shingle_set(t, size) for t in texts]
        assert np.diff(at).tolist() == [len(x) for x in sets]
        for i, t in enumerate(texts):
            own, _ = minhash_dedup.shingle_sets(pa.array([t], pa.string()), size)
            assert own.tolist() == s[at[i] : at[i + 1]].tolist() == sorted(set(own.tolist()))


def test_ids_with_several_texts(spark, docs_of):
    # Each row is linked by its own text, and links between other ids don't hang on it.
    a, b = " ".join(f"a{i}" for i in range(59)), " ".join(f"b{i}" for i in range(59))
    docs = docs_of([a, b, b, b + " more", a, "", ""], [1, 1, 2, 3, 7, 5, 5])
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(docs, 2).collect()]
    assert sorted(rows) == [(1, 58, 1), (1, 58, 1), (2, 58, 1), (3, 59, 1), (5, 0, 5), (5, 0, 5), (7, 58, 1)]
    swapped = docs_of([b, a, b, b + " more", a], [9, 9, 2, 3, 7])
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(swapped, 2).collect()}
    assert rows == {(9, 58, 2), (9, 58, 7), (2, 58, 2), (3, 59, 2), (7, 58, 7)}
    kept = minhash_dedup.keep_one(docs_of([a, a, a, b, "", None, a], [4, 4, 4, 4, 6, 6, None]), 2).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(4, a), (4, b), (6, ""), (6, ""), (0, a)])


def test_clashing_columns(spark, tmp_path):
    names = ["doc_id", "text", "file", "row", "in", "id", "top", "key", "n", "_metadata", "_gone"]
    spark.createDataFrame([(1, "a b c d e f", *"xxxxxxxxx"), (2, "a b c d e f", *"yyyyyyyyy")], names).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", *"xxxxxxxxx")]


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = minhash_dedup.near_duplicates(odd_docs.withColumnRenamed("lang", "component_id").withColumnRenamed("source", "key")).collect()
    assert len(rows) == odd_docs.count() and not next(r for r in rows if r["doc_id"] is None)["kept"]
    same = {r["component_id"] for r in rows if r["doc_id"] in (8, 9)}
    assert same == {8}
    assert minhash_dedup.near_duplicates(no_docs).count() == 0 and minhash_dedup.keep_one(no_docs).count() == 0
    kept = minhash_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 9").isEmpty() and kept.where("doc_id is null").count() == 1


# Vectors -----------------------------------------------------------------------


def brute_vectors(x, threshold=0.9):
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(x).all(1) & (norm > 0)
    unit = np.where(good[:, None], x / np.where(good, norm, 1)[:, None], 0)
    hit = (unit @ unit.T >= threshold) & good[:, None] & good[None]
    np.fill_diagonal(hit, False)
    return hit.sum(1), groups(len(x), [(i, j) for i, j in np.argwhere(hit) if i > j])


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")


def test_links_reach_recall(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([centres[rng.integers(60, size=900)] + rng.normal(scale=0.25, size=(900, 24)), rng.normal(size=(600, 24)), np.repeat(centres[:1], 200, 0)]).astype("float32").astype(float)
    n, comp = brute_vectors(x)
    rows = embedding_dedup.link_embeddings(vectors(spark, x).repartition(4), list_rows=40).orderBy("vec_id").collect()
    got = np.array([r["n_links"] for r in rows])
    assert got.tolist() == n.tolist()
    assert [r["component_id"] for r in rows] == comp
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_no_link_is_lost_in_a_group_of_near_copies(spark, monkeypatch):
    # A third of the rows are near copies, so that a third of some 200 lists lie in one small place.
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "SPAN", 500 * 64)
    rng = np.random.default_rng(15)
    copies = rng.normal(size=64) + rng.normal(scale=0.33, size=(800, 64))
    tight = rng.normal(size=64) + rng.normal(scale=0.02, size=(150, 64))
    x = np.concatenate([copies, tight, rng.normal(size=(1450, 64)), np.repeat(copies[:1], 20, 0)]).astype("float32").astype(float)
    n, comp = brute_vectors(x)
    rows = embedding_dedup.link_embeddings(vectors(spark, x).repartition(4), list_rows=12).orderBy("vec_id").collect()
    assert [r["n_links"] for r in rows] == n.tolist()
    assert [r["component_id"] for r in rows] == comp


def test_table_step_loses_nothing():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(400, 30)) + 3 * rng.normal(size=(8, 30))[rng.integers(8, size=400)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dedup.train(x, 1, subspaces=7, codewords=16)
    of, codes, error = index.encode(x)
    may = embedding_dedup.candidates(index, 0, codes, error, x, 0.9)
    hit = x @ x.T >= 0.9
    assert may[hit].all() and may.mean() < 0.5


def test_ids_with_several_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b"), (2, [1.0, 0.1], "c"), (3, [0.1, 1.0], "d"), (1, [1.0, 0.0], "e"), (None, [1.0, 0.0], "f")], "vec_id long, embedding array<float>, k string")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embedding_dedup.link_embeddings(rows.withColumns({"v": F.lit(1), "id": F.lit(2)})).collect())
    assert got == [(0, 0, 0, False), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_odd_vectors(spark):
    rows = [None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 0.0], [2.0, 0.0], [1e-30, 0.0], [1.0, 0.1], [0.0, 1.0], [1.0], [1.0, 0.0, 0.0], []]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_embeddings(vectors(spark, rows)).collect()}
    assert all(out[i] == (0, i, True) for i in (0, 1, 2, 3, 4, 9, 10, 11, 12))
    assert [out[i] for i in (5, 6, 7, 8)] == [(3, 5, True), (3, 5, False), (3, 5, False), (3, 5, False)]
    assert embedding_dedup.link_embeddings(vectors(spark, [])).count() == 0


def test_registered_rows(spark):
    assert QUERIES["op9_embedding_dedup"](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_blocks_are_linear_in_a_bucket_with_few_outsiders(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 64)
    # One component of 20,000 and ten outsiders in one bucket; a second bucket of one component; a third of two.
    rows = [(1, k, 0, 10, 0 if k < 20_000 else k) for k in range(20_010)] + [(2, k, 0, 10, 0) for k in range(50)] + [(3, k, 0, 10, k % 2) for k in range(100)]
    placed = written(spark.createDataFrame(rows, "bh long, cid long, hub long, bytes long, comp long"), "placed")
    got = minhash_dedup._blocks(placed, []).collect()
    first = [r for r in got if r["bh"] == 1]
    assert len(first) <= 20_010 + 10 * (20_010 // 64 + 1) + 10 and not [r for r in got if r["bh"] == 2]
    # Every outsider meets every member of another component in some block.
    for bucket in (1, 3):
        blocks = {}
        for r in (r for r in got if r["bh"] == bucket):
            blocks.setdefault((r["i"], r["j"]), ([], []))[r["side"]].append(r["cid"])
        met = {(x, y) for members, out in blocks.values() for x in out for y in members}
        own = {r[1]: r[4] for r in rows if r[0] == bucket}
        main = max(set(own.values()), key=list(own.values()).count)
        assert all((x, y) in met or (y, x) in met for x, a in own.items() if a != main for y in list(own)[:: 1 if bucket == 3 else 997] if own[y] != a)


def test_the_shortest_text_stands_for_a_class(spark, docs_of):
    words = " ".join(f"w{i}" for i in range(40))
    long = " ".join([words] * 300)  # shingles of one word: the same set
    rows = minhash_dedup.near_duplicates(docs_of([long, words, words + " w40", "else"]), size=1).collect()
    assert [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [0, 0, 0, 3]


def test_scratch_keeps_only_what_results_read(spark, docs_of, tmp_path):
    from millrace.llm.common import _scratch, clear_scratch

    clear_scratch(spark)
    words = [" ".join(f"w{(i * k) % 50}" for k in range(60)) for i in range(1, 20)]
    minhash_dedup.near_duplicates(docs_of(words + words)).collect()
    left = {r.rsplit("-", 1)[0] for r in os.listdir(_scratch(spark).removeprefix("file://"))}
    assert left <= {"settled", "signatures", "by-key"}, left


def test_unique_join_keeps_hot_keys_apart_without_a_join(spark):
    # Numbers, bytes and structs as keys; half of all rows have one key.
    from pyspark.sql import functions as F

    from millrace.llm.common import join_unique

    left = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("n"), "id")
    forms = {"long": F.col("n"), "bytes": F.unhex(F.sha2(F.col("n").cast("string"), 256)), "struct": F.struct(F.col("n").alias("a"), (-F.col("n")).alias("b"))}
    for form in forms.values():
        rows = left.select(form.alias("key"), "n", "id")
        right = rows.groupBy("key").agg(F.count("*").alias("w"), F.max("n").alias("m"))
        got = join_unique(rows, right, "key", "w")
        assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["id"] for r in got.collect()) == list(range(4000)) and got.where("n <> m").isEmpty()
