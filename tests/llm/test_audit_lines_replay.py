import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

from millrace.llm import filter_audit, line_dedup, queries, ranks, replay
from pyspark.sql import functions as F

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


# Filter audit ------------------------------------------------------------------


def fails_of(text, copy):
    w = WORD.findall(text)
    found = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
    return {k for k, v in found.items() if v}


def audited(docs, labels):
    least = {}
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    out = defaultdict(Counter)
    orders = ["".join(p) for p in permutations("ABCDE")]
    for r in docs:
        text, i = r["text"] or "", r["doc_id"]
        f, part = fails_of(text, i is not None and i > least[text]), r["source"] or ""
        for o in orders:
            gone = False
            for k, x in enumerate(o):
                c = out[part, o, k + 1]
                c["unique_fails"] += f == {x}
                if x in f:
                    c["redundant" if gone else "removed"] += 1
                    if not gone:
                        c["good_lost"] += i in good
                        c["toxic_lost"] += i in toxic
                    gone = True
                elif not gone:
                    c["kept"] += 1
    total = Counter()
    for (part, o, k), c in out.items():
        total[part, o[k - 1]] += c["removed"]
    return {(part, o, k, *[c[n] for n in names], total[part, o[k - 1]]) for (part, o, k), c in out.items()}


def test_audit_equals_brute_force(spark, docs_of, odd_docs, no_docs):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["a", "B", "cc", "#x", "dd"]) for _ in range(rnd.choice([3, 150, 250]))) for _ in range(30)]
    texts += [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(300))] + texts[:10] + [None, ""]
    docs = docs_of(texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "p").when(F.col("doc_id") % 3 == 1, "q")).withColumn("a.b", F.lit(1)).withColumn("mask", F.lit("x")).withColumn("id", F.lit(None))
    labels = spark.createDataFrame([(i, rnd.randrange(2), rnd.randrange(2)) for i in range(0, 40)] + [(1, None, None), (2, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for d, some in ((docs, labels), (odd_docs, labels), (odd_docs, none)):
        got = [tuple(r) for r in filter_audit.audit_filters(d, some).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
        assert len(got) == len(set(got)) and set(got) == audited(d.collect(), some.collect())
    assert filter_audit.audit_filters(no_docs, labels).count() == 0


def test_copies_of_repeated_and_nameless_rows(docs_of, spark):
    same = " ".join(f"w{i}" for i in range(300))
    docs = docs_of([same] * 5 + ["other"] * 2, [7, 7, 3, 3, None, None, None])
    cells = {r["mask"]: r["n"] for r in filter_audit.cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert cells == {16: 2, 0: 3, 1: 2}


def test_fewer_filters(docs_of, spark):
    docs = docs_of(["a b", "a b", "#"])
    filters = (filter_audit.Filter("X", "is_copy"), filter_audit.Filter("Y", "n_marks > 0"))
    rows = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in filter_audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters).collect()}
    assert rows == {("XY", 1): (2, 1, 2), ("XY", 2): (1, 1, 2), ("YX", 1): (2, 1, 2), ("YX", 2): (1, 1, 2)}


# Shared lines ------------------------------------------------------------------


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def cleaned(rows, least):
    found = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key_of(line):
                found[key_of(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(found[key_of(x)]) < least or not key_of(x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(docs_of, odd_docs, no_docs):
    rnd = random.Random(12)
    bits = ["Common line", " common LINE\t", "É common", "é common", "", "  ", "rare", "x\ry", "\x0bcommon line\r"] + [f"line {i}" for i in range(12)]
    texts = ["\n".join(rnd.choice(bits) for _ in range(rnd.randrange(8))) for _ in range(60)] + [None, "", "common line\n" * 3000, "\n"]
    docs = docs_of(texts, [*range(55), 1, 1, 1, None, None, *range(60, 64)]).withColumn("a.b", F.lit(1)).withColumn("in", F.lit(2)).withColumn("lines", F.lit(3)).withColumn("file", F.lit("f"))
    for d, least in ((docs, 5), (docs, 1), (odd_docs, 2)):
        got = sorted([tuple(r) for r in line_dedup.clean(d, least).select("in.doc_id", "n_lines", "n_dropped", "kept").collect()], key=repr)
        assert got == cleaned([(r["doc_id"], r["text"]) for r in d.collect()], least)
    assert line_dedup.clean(no_docs).count() == 0
    out = line_dedup.drop_lines(docs, 5)
    assert out.columns == docs.columns and out.count() == len(texts) and out.where("text is null").count() == 1
    assert {r["a.b"] for r in out.collect()} == {1}


def test_registered_lines_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in cleaned(docs, 10)}
    got = [tuple(r) for r in queries.op12_line_dedup(spark, SF).collect()]
    assert set(got) == want and len(got) == len(docs) and any(k for _, _, k, _ in want)


def test_one_document_does_not_make_a_line_common(docs_of):
    docs = docs_of(["again"] * 20 + ["again\n" * 50], [5] * 20 + [6])
    assert line_dedup.clean(docs, 3).agg(F.sum("n_dropped")).first()[0] == 0


# Ranks and replay --------------------------------------------------------------


def test_ranks_of_groups_over_many_tasks(spark):
    rnd = random.Random(13)
    rows = [(0 if rnd.random() < 0.5 else rnd.randrange(40), k, rnd.randrange(2**32)) for k in range(3000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {(r["g"], r["k"]): (r["rank"], r["total"]) for r in ranks.ranked(spark.createDataFrame(rows, "g long, k long, w long"), ["g"], ["k"], "w").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen, total = Counter(), Counter()
    for g, k, w in sorted(rows, key=lambda r: r[1]):
        seen[g] += 1
        total[g] += seen[g] * w
        assert got[g, k] == (seen[g], total[g])
    assert len(got) == len(rows)


def replayed(rows):
    groups = defaultdict(list)
    for conv, turn, text in rows:
        groups[conv].append((turn is not None, turn if turn is not None else 0, zlib.crc32((text or "").encode()), turn))
    out = []
    for conv, turns in groups.items():
        told, all_ = {}, []
        for p, (_, _, crc, turn) in enumerate(sorted(turns, key=lambda t: t[:3])):

            def h(k, turn=turn):
                return zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode())

            d = h(0) % 5
            parent = told[p - d] if 0 < d <= p else None
            if parent and parent[0] != "delivered":
                told[p] = ("blocked", 0, None, None)
            else:
                at = first = max(7 * p, parent[3]) if parent else 7 * p
                faulty, status, a = h(1) % 101 < 50, "dead", 1
                while True:
                    if not faulty or not (at < 7 * p + h(2) % 101 or h(a + 2) % 3 == 0):
                        status = "delivered"
                        break
                    if a == 6:
                        break
                    at += 20 * 2 ** (a - 1)
                    a += 1
                told[p] = (status, a, first, at)
            all_.append((p, turn, crc))
        order = sorted(((told[p][3], turn is not None, turn or 0, p, crc) for p, turn, crc in all_ if told[p][0] == "delivered"))
        released, state = {}, 0
        for n, (_, _, _, p, crc) in enumerate(order, 1):
            state += n * crc
            released[p] = (n, state)
        out += [(conv, turn, *told[p], *released.get(p, (None, None))) for p, turn, _ in all_]
    return sorted(out, key=repr)


def test_replay_equals_brute_force(spark):
    rnd = random.Random(14)
    rows = [(5, t, f"text {t}") for t in rnd.sample(range(2000), 700)] + [(c, t, rnd.choice(["a", None, "é"])) for c in range(-3, 30) for t in range(rnd.randrange(1, 9))]
    rows += [(2, 3, "again"), (2, 3, "again"), (2, None, "x"), (2, None, None), (None, 0, "n"), (None, 1, "m"), (None, None, "o"), (0, 0, "zero")]
    rnd.shuffle(rows)
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, text string, `p.rank` int")
    got = sorted([tuple(r) for r in replay.replay(turns).collect()], key=repr)
    assert got == replayed(rows)
    assert {r[2] for r in got} == {"delivered", "dead", "blocked"}
    assert replay.replay(turns.limit(0)).count() == 0


def test_messages_cross_blocks(spark, monkeypatch):
    # Small blocks: chains of turns run through many, so that supersteps follow on each other.
    rows = [(1, t, str(t)) for t in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    steps = []
    old = replay.written
    monkeypatch.setattr(replay, "written", lambda df, name: steps.append(name) or old(df, name))
    assert sorted([tuple(r) for r in replay.replay(turns, 5).collect()], key=repr) == replayed(rows)
    assert steps.count("finished") > 2


def test_registered_replay_equals_brute_force(spark):
    rows = [(r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert sorted([tuple(r) for r in queries.op13_cascading_release(spark, SF).collect()], key=repr) == replayed(rows)
