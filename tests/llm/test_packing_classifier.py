import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from millrace.llm import nbsvm, packing
from millrace.llm.queries import QUERIES, vocabulary
from millrace.llm.words import Known
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..conftest import SF

ALPHA = [*"ab cd  \n\t\r.,!éßñ中文😀'sΣİ\x1c\x85\xa0́ﬁ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'ll", "123", "Word.", "word!"]


def test_ids_are_the_librarys():
    spec = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_str(spec.decode())
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(ALPHA) for _ in range(rnd.randrange(40))) for _ in range(5000)]
    own = packing.Vocabulary(spec)
    known = Known(own.encode, entries=50)
    for some in (texts[:10], texts, *[[t] for t in texts], [None, "", " \n"], []):
        ids, at = packing.encode_words(own, pa.array(some, pa.string()), known)
        for k, text in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_plan_places_everything_tightly():
    rng = np.random.default_rng(7)
    for n, shape in ((3000, lambda k: rng.lognormal(6.5, 1, k)), (500, lambda k: rng.integers(1, 5, k)), (200, lambda k: np.full(k, 2049)), (1, lambda k: np.array([4096])), (700, lambda k: rng.integers(1, 4097, k))):
        lengths = Counter(np.clip(shape(n).astype(int), 1, 4096).tolist())
        plan = packing.pack(dict(lengths), 4096)
        placed = Counter()
        for own, times in plan:
            assert sum(own) <= 4096 and times > 0
            for x in own:
                placed[x] += times
        assert placed == lengths
        plain = sum(t for _, t in packing.best_fit(dict(lengths), [], 4096))
        assert sum(t for _, t in plan) <= max(plain * 1.01, plain + 2)
    assert packing.pack({}, 4096) == []


def test_patterns_and_least_squares():
    ways = packing.patterns(6, 3, np.ones(8, bool))
    assert sorted(ways) == sorted({tuple(sorted((a, b, 6 - a - b), reverse=True)) for a in range(1, 6) for b in range(1, 6 - a)} | {(6,), (5, 1), (4, 2), (3, 3)})
    a = np.array([[1.0, 0, 1], [0, 2, 1]])
    assert np.allclose(a @ packing.least_squares(a, np.array([3.0, 4.0])), [3, 4], atol=1e-3)


def check_pieces(rows, texts):
    spec = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_str(spec.decode())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_packed_documents(spark, docs_of, odd_docs, no_docs):
    rnd = random.Random(8)
    texts = dict(enumerate([None, "", "x", *[" ".join(["word", "other", "x."][rnd.randrange(3)] for _ in range(rnd.randrange(9000))) for _ in range(40)], "tie tie", "tie tie"]))
    check_pieces(packing.pack_documents(docs_of(list(texts.values())).repartition(3), vocabulary("word_bpe_49k.json")).collect(), texts)
    assert packing.pack_documents(no_docs, vocabulary("word_bpe_49k.json")).count() == 0
    odd = packing.pack_documents(odd_docs, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    assert len(odd) >= odd_docs.count() and all(len(r["ids"]) == r["length"] for r in odd)
    con = duckdb.connect()
    check_pieces(QUERIES["op8_packing"](spark, SF).collect(), dict(con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()))


# The classifier --------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    rows = QUERIES["op7_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = Counter((r["quality"], r["quality"] == r["predicted"]) for r in rows)
    assert right[1, True] / (right[1, True] + right[1, False]) > 0.95
    assert right[0, True] / (right[0, True] + right[0, False]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_dual_descent_parts_the_classes():
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 20, 5)) for _ in range(200)]
    label = np.array([float(3 in r) for r in rows])
    model = nbsvm.fit_rows(rows, label)
    score = model.scores(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
    assert np.mean((score >= 0.5) == (label > 0)) > 0.97


def test_hinge_optimum():
    # Two rows on two features: the dual's optimum is known.
    w = nbsvm.dual_descent([np.array([0]), np.array([1])], np.array([1.0, 1.0]), np.array([1.0, -1.0]), epochs=50)
    assert np.allclose(w, [1, -1])


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (1, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = nbsvm.fit(odd_docs, labels)
    docs = odd_docs.withColumnRenamed("source", "score")
    out = nbsvm.score(docs, model, column="p")
    assert out.columns == [*docs.columns, "p"] and out.count() == docs.count() and out.where("p is null or p < 0 or p > 1").isEmpty()
    assert nbsvm.keep_good(docs, model).columns == docs.columns
    odd = docs.withColumnsRenamed({"lang": "_text", "n_chars": "_score"}).withColumn("in", F.lit(1))
    assert nbsvm.score(odd, model, column="_p").count() == docs.count() and nbsvm.keep_good(odd, model).columns == odd.columns
    empty = nbsvm.fit(no_docs, labels)
    assert nbsvm.score(odd_docs, empty).where("score <> 0.5").isEmpty() and nbsvm.score(no_docs, model).count() == 0
    ones = nbsvm.fit(odd_docs, labels.where("quality = 1"))
    assert nbsvm.score(odd_docs, ones).where("score < 0.5").isEmpty()


def test_sample_is_bounded(odd_docs, spark):
    labels = spark.createDataFrame([(8, 1, 0)] * 50 + [(4, 0, 0)] * 50, "doc_id long, quality int, toxic int")
    assert nbsvm.fit(odd_docs, labels, sample_rows=10).bias is not None


def brute_ngrams(text):
    """The numbers of a text's n-grams, word by word."""
    m = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    code = [zlib.crc32(w.encode()) for w in words]
    form = [nbsvm._form(w) + 32 * (k > 0 and words[k - 1] == w) for k, w in enumerate(words)]
    first = nbsvm.WORDS + nbsvm.PAIRS
    out = {c % nbsvm.WORDS for c in code} | {first + f for f in form}
    out |= {nbsvm.WORDS + mixed(a << 32 | b) % nbsvm.PAIRS for a, b in zip(code, code[1:])}
    out |= {first + nbsvm.FORMS + a * nbsvm.FORMS + b for a, b in zip(form, form[1:])}
    return out | {first + nbsvm.FORMS + nbsvm.FORMS**2 + (a * nbsvm.FORMS + b) * nbsvm.FORMS + c for a, b, c in zip(form, form[1:], form[2:])}


def test_registered_scores_equal_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # The model of the labelled rows that aren't held out, from n-grams taken word by word.
    rows = sorted((i, y, sorted(brute_ngrams(docs[i]))) for i, y in labels.items() if not out(i) and y in (0, 1) and i in docs)
    model = nbsvm.fit_rows([np.array(x, np.int32) for *_, x in rows], np.array([y for _, y, _ in rows]))
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_classifier"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = sorted(brute_ngrams(text))
        margin = float(model.weight[ids].sum(dtype=float)) / max(float(model.square[ids].sum(dtype=float)) ** 0.5, 1e-9)
        score = 1 / (1 + np.exp(-(model.bias + model.slope * margin)))
        assert abs(got[i]["score"] - score) < 1e-6 and got[i]["held_out"] == out(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_repeated_ids_are_cut_alike(spark, docs_of):
    texts = [f"good words number {i} stand here" for i in range(20)] + [f"BAD!!! {i} $$$" for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = docs_of(texts + texts[::-1] * 3, [*range(40), *list(range(40))[::-1] * 3])
    some = [nbsvm.fit(d, labels, sample_rows=12) for d in (docs, docs.orderBy(F.rand(1)), docs_of(texts))]
    assert all(np.array_equal(some[0].weight, m.weight) and some[0].bias == m.bias for m in some[1:])
