"""Sources, text functions, tables and chunking."""

import random
import re
import zipfile

import pytest
from millrace.config import Chunking, Config, Retrieval, load_config
from millrace.functions import tables, text
from millrace.operators import chunk
from millrace.sources import files
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("regu-\nlation", "regulation"),
        ("x -\n y", "x y"),
        ("a​b﻿", "ab"),
        ("é", "é"),
        ("a \t b", "a b"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("  a　", "a"),
        ("", ""),
        (None, None),
    ],
)
def test_clean(spark, raw, clean):
    assert one(spark, raw, text.clean_whitespace) == clean


@pytest.mark.parametrize(
    ("t", "hint"),
    [
        ("", "mixed"), ("123", "mixed"), ("word", "en"), ("wash", "uz-latn"), ("[", "en"), ("Oʻzbek", "uz-latn"),
        ("китоб", "uz-cyrl"), ("объект", "ru"), ("китоб word", "mixed"), ("а" * 49 + "ы", "uz-cyrl"), ("а" * 48 + "ы", "ru"), ("a" * 500 + "sh", "en"),
    ],
)
def test_script(spark, t, hint):
    assert one(spark, t, text.detect_script) == hint


def test_latin(spark):
    assert one(spark, "Шаҳар Ўзбекистон Ғалаба чой юлдуз Яна ёш ҳақ Қуръон мактабь ЩщЦц", text.to_latin) == "Shahar Oʻzbekiston Gʻalaba choy yulduz Yana yosh haq Qurʼon maktab ЩщSs"
    got = one(spark, " китоб  ш ", text.normalize)
    assert (got["text"], got["hint"]) == ("kitob sh", "uz-latn")
    kept = one(spark, "китоб", lambda c: text.normalize(c, latin=False))
    assert (kept["text"], kept["hint"]) == ("китоб", "uz-cyrl")


def test_tokens(spark):
    assert one(spark, "Oʻzbek It's café_1, ДОМ!", text.tokens) == ["oʻzbek", "it's", "café_1", "дом"]


TABLE = "array<array<string>>"


@pytest.mark.parametrize(
    ("cells", "ok"),
    [
        ([["a", "b"], ["c", "d"]], True),
        ([["a", "b"]], False),
        ([["a"], ["b"], ["c"]], False),
        ([["a", "b"], ["c", None]], False),
        ([["a", "b"], ["c", "x" * 300]], True),
        ([["a", "b"], ["c", "x" * 301]], False),
        ([["x" * 80, "x" * 80], ["x" * 80, "x" * 80]], True),
        ([["x" * 81, "x" * 80], ["x" * 80, "x" * 80]], False),
        ([["a", "b"], ["c", "d", "e"], []], True),
        ([], False),
        (None, False),
    ],
)
def test_table_guard(spark, cells, ok):
    if cells and len(cells[0]) == 2 and cells[-1] == ["c", "x" * 300]:
        ok = sum(map(len, sum(cells, []))) <= 80 * 4  # its mean is above 80
    assert spark.createDataFrame([(cells,)], f"c {TABLE}").select(tables.looks_like_table(F.col("c")).alias("r")).first()["r"] is ok
    if cells:
        assert files._is_table(cells) is ok


def test_markdown(spark):
    md = lambda cells: spark.createDataFrame([(cells,)], f"c {TABLE}").select(tables.to_markdown(F.col("c")).alias("r")).first()["r"]
    assert md([["a", " b\nc "], ["d"], [None, "x|y", "z"]]) == "| a | b c |  |\n| --- | --- | --- |\n| d |  |  |\n|  | x|y | z |"
    assert md([[], ["a"]]) == "" and md([]) == "" and md([["h"]]) == "| h |\n| --- |"


def heads(t):
    return chunk.boundaries(t, chunk.heading_re())


def test_boundaries():
    assert heads("12-modda. Baz") == [(0, "12")]
    assert heads("x\n\n5. Xarid") == [(2, "")]
    assert heads("СТАТЬЯ 5\nстатья 6: b") == [(0, "СТАТЬЯ 5"), (9, "статья 6")]
    assert heads("1-ILOVA") == [(0, "1")] and heads("IV BOʻLIM") == [(0, "IV BOʻLIM")]
    assert heads("Ilova " + "x" * 60)[0][1] == ("Ilova " + "x" * 60)[:40]
    assert heads("no heading here") == []


def test_segments():
    seg = lambda t: chunk.segments(t, chunk.heading_re())
    assert seg("plain") == [(0, None, "plain")]
    assert seg("pre\nArticle 1\nbody\nArticle 2") == [(0, None, "pre"), (4, "Article 1", "Article 1\nbody"), (19, "Article 2", "Article 2")]
    assert seg("  \nArticle 1") [0][1] == "Article 1"


def test_segments_in_the_jvm(spark):
    pieces = ["12-modda. Baz", "СТАТЬЯ 5: x", "\n\n 7. Ўлчов", "\u00a05. Xarid", "٣-bob", "IV boʻlim — ъ", "Ilova", "plain", "", " ", "\t", "x\u2028Article 3", "a\r", "\ufdd0", "\ufdd0\ufdd1", "😀 body", "Article " + "9" * 60, "приложение", "1234. B"]
    rng = random.Random(2)
    texts = ["", " ", None, "\ufdd0", "Article 1", *["\n".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in chunk.segment_rows(rows, ["id"]).orderBy("id", "off").collect():
        got.setdefault(r["id"], []).append((r["off"], r["label"], r["content"]))
    want = {i: [s for s in chunk.segments(t, chunk.heading_re()) if s[2]] for i, t in enumerate(texts) if t is not None}
    assert got == {i: s for i, s in want.items() if s}
    plan = chunk.segment_rows(rows, ["id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_segments_are_cut_where_the_texts_lie(spark):
    # Sizes on both sides of powers of two, where sums of offsets take one more round; and bodies of more than one byte a character.
    texts = ["\n".join(f"{i}-modda. ў😀{'x' * (i % 7)}" for i in range(n)) for n in (1, 2, 3, 4, 5, 8, 9, 127, 128, 129, 3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    out = chunk.segment_rows(rows, ["id"])
    got = {i: [] for i in range(len(texts))}
    for r in out.collect():
        got[r["id"]].append((r["off"], r["label"], r["content"]))
    assert got == {i: [s for s in chunk.segments(t, chunk.heading_re()) if s[2]] for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_patterns_share_an_anchor(spark):
    assert chunk._heading(chunk.ARTICLE_PATTERNS).count("^") == 1
    pieces = ["ab", "b1", "c", "xb", "d", "xd", "xc2", " e\n", "e 3", "", "\n", "f-"]
    rng = random.Random(3)
    texts = ["\n".join(rng.choices(pieces, k=rng.randrange(8))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for patterns in (["d", "^c", r"e\s*\d?"], ["a|b", "c"], ["c", "^d|2", r"\s*e", "f"], ["(a|b)", "d"], ["x"]):
        heading = chunk.heading_re(patterns)
        got = {i: [] for i in range(len(texts))}
        for r in chunk.segment_rows(rows, ["id"], patterns=patterns).orderBy("id", "off").collect():
            got[r["id"]].append((r["off"], r["content"]))
        assert got == {i: [(off, c) for off, _, c in chunk.segments(t, heading) if c] for i, t in enumerate(texts)}, patterns


def test_strip_takes_time_linear_in_a_text(spark):
    import time

    rng = random.Random(4)
    white = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert sorted(text.WS_CHARS) == white
    texts = ["", None, " ", *["".join(rng.choices([*white, "a", "ў", "😀", "\u200b", "\ufeff", "\x00", "é"], k=rng.randrange(9))) for _ in range(2000)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.strip(F.col("t")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in rows} == {k: t and t.strip() for k, t in enumerate(texts)}
    began = time.time()
    assert one(spark, "a" + " " * 100_000 + "b", text.strip) == "a" + " " * 100_000 + "b"
    assert time.time() - began < 10


def test_split_properties():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["word", "longerword", " ", " ", ". ", "\n", "\n\n", "; ", "x" * 30]) for _ in range(rng.randrange(200)))
        pieces = chunk.recursive_split(t, 60, 15)
        assert all(0 < len(p) <= 60 for p in pieces)
        at = 0
        for p in pieces:
            found = t.find(p, max(0, at - 75))
            assert found >= 0
            at = found + len(p)
        assert set(re.sub(r"\s", "", t)) == set(re.sub(r"\s", "", "".join(pieces)))
    assert chunk.recursive_split("x" * 2000) == ["x" * 800] * 2 + ["x" * 640]
    assert chunk.recursive_split("a" * 801)[0] == "a" * 800
    two = chunk.recursive_split("ab " * 300)
    assert two[1][:30] in two[0]


def blocks(spark, rows):
    return spark.createDataFrame([("p", "f", "a" * 64, "en", i, k, c, 1) for i, (k, c) in enumerate(rows)], "source_path string, filename string, file_hash string, language_hint string, block_idx int, kind string, content string, page int")


def test_chunks(spark):
    body = " this body is long enough to be kept"
    rows = [
        ("text", f"preamble{body}\nIlova 1\n{body}\n3-modda. Uch{body}"),
        ("table", "| " + "x" * 900),
        ("text", f"4-modda.{body}"),
        ("text", f"no heading{body}"),
        ("text", "short"),
        ("text", "y" * 29),
        ("text", "y" * 30),
        ("text", "z" * 801),
    ]
    out = chunk.chunk_blocks(blocks(spark, rows)).orderBy("chunk_id").collect()
    assert [r["article_label"] for r in out] == [None, "Ilova 1", "Ilova 1 / 3", "Ilova 1", "Ilova 1 / 4", None, None, None, None]
    assert [r["chunk_id"] for r in out] == [f"aaaaaaaa_{i:04d}" for i in range(9)]
    assert [len(r["content"]) for r in out][-3:] == [30, 800, 121][:3] or len(out[-1]["content"]) >= 30
    assert out[3]["kind"] == "table" and len(out[3]["content"]) == 902 and out[6]["token_estimate"] == 7


def docx(path, paragraphs, cells):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in cells) + "</w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")


def test_files(spark, tmp_path):
    (tmp_path / "hr/deep").mkdir(parents=True)
    (tmp_path / "a.TXT").write_bytes(b"Hello \xff w-\nord")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "skip.csv").write_text("x")
    (tmp_path / "hr/deep/bad.docx").write_bytes(b"not a zip")
    docx(tmp_path / "hr/ok.docx", ["китоб", " ", "p" * 1499, "tail"], [["a", "b"], ["c", "d"]])
    scan = files.scan(spark, str(tmp_path))
    docs = {r["filename"]: r for r in files.load(scan).collect()}
    assert set(docs) == {"a.TXT", "empty.txt", "bad.docx", "ok.docx"}
    assert [tuple(b) for b in docs["a.TXT"]["blocks"]] == [("text", "Hello � word", 1)] and docs["a.TXT"]["language_hint"] == "en"
    assert docs["empty.txt"]["blocks"] == [] and docs["empty.txt"]["total_pages"] == 1 and docs["empty.txt"]["language_hint"] == "mixed"
    assert docs["bad.docx"]["error"].startswith("BadZipFile") and docs["bad.docx"]["blocks"] == []
    ok = docs["ok.docx"]
    assert [(b["kind"], b["page"]) for b in ok["blocks"]] == [("text", 1), ("text", 1), ("table", 1)] and ok["blocks"][2]["content"].startswith("| a | b |")
    blocks_ = files.blocks_of(files.load(scan))
    assert blocks_.where("filename = 'ok.docx'").count() == 3
    from millrace.operators.access import department_of

    rel = scan.select(department_of(files.relative(F.col("source_path"), str(tmp_path)), "general").alias("d")).distinct()
    assert {r["d"] for r in rel.collect()} == {"hr", "general"}


def test_paragraph_groups():
    assert files.grouped_paragraphs(["a" * 1498, "b"]) == [("a" * 1498 + "\nb", 1)]
    assert files.grouped_paragraphs(["a" * 1499, "b", " "]) == [("a" * 1499, 1), ("b", 1)]
    assert files.grouped_paragraphs([]) == []
    assert files.grouped_paragraphs(["a" * 3000, "b"]) == [("a" * 3000, 2), ("b", 2)]


def test_outside(spark):
    chars = spark.createDataFrame([(1, 1, 1.0, 2.0, 1.0, 2.0), (1, 1, 0.0, 2.0, 1.0, 2.0), (1, 2, 1.0, 2.0, 1.0, 2.0), (1, 1, 1.0, 5.0, 1.0, 5.0)], "doc int, page int, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([(1, 1, 1.0, 5.0, 1.0, 5.0)], chars.schema)
    assert files.outside(chars, boxes).count() == 2


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("chunking: {size: 100, overlap: 10}\nretrieval: {rrf_k: 10}\naudit: {path: logs}\n")
    c = load_config(path)
    assert (c.chunking.size, c.retrieval.rrf_k, c.retrieval.top_k_bm25, c.audit_path) == (100, 10, 20, "logs")
    assert Config().agent.max_query_rewrites == 2
    for bad in (lambda: Chunking(size=0), lambda: Chunking(overlap=800), lambda: Retrieval(top_k_bm25=0)):
        with pytest.raises(ValueError):
            bad()
    path.write_text("unknown: 1")
    with pytest.raises(ValueError):
        load_config(path)


def test_commas_are_no_separators():
    text = "word, " * 200
    pieces = chunk.recursive_split(text)
    assert all(len(p) <= 800 for p in pieces) and "".join(pieces).count(",") >= 200
    # Cut at spaces: a comma stays with its word.
    assert all(p.startswith("word") and p.endswith(",") for p in pieces)


def test_spread_never_goes_below_what_spark_makes(spark, tmp_path):
    from millrace.functions.spread import spread

    spark.range(100_000).repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(11).write.parquet(str(tmp_path / "many"))
    parts = lambda df: df.rdd.getNumPartitions()
    assert parts(spread(spark.read.parquet(str(tmp_path / "one")).where("id > 5").select("id"))) == spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        one = spark.read.parquet(str(tmp_path / "one"))
        assert parts(spread(one)) == parts(one) > spark.sparkContext.defaultParallelism
        grouped = one.groupBy("id").count()
        assert spread(grouped) is grouped
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_outside_equals_comparing_all(spark):
    import random

    rnd = random.Random(31)

    def corners(wide):
        x, y = rnd.uniform(-50, 900), rnd.uniform(-50, 900)
        return x, x + rnd.uniform(0, wide), y, y + rnd.uniform(0, wide)

    # One heavy page, boxes from a point to more than a page.
    chars = [(1, 1 if k % 5 else k % 7, k, *corners(6)) for k in range(1500)] + [(1, 1, 1500, 10.0, 10.0, 10.0, 10.0), (None, 1, 1501, 0.0, 1.0, 0.0, 1.0), (1, 1, 1502, None, 1.0, 0.0, 1.0)]
    boxes = [(1, rnd.choice([1, 1, 1, 2, 3]), *corners(rnd.choice([0, 20, 90, 300]))) for _ in range(60)] + [(1, 4, -1000.0, 5000.0, -1000.0, 5000.0), (1, 1, 10.0, 10.0, 10.0, 10.0), (1, 5, 9.0, 1.0, 0.0, 900.0), (1, 6, None, 900.0, 0.0, 900.0)]
    held = lambda c, b: None not in (*c, *b) and c[0] == b[0] and c[1] == b[1] and c[3] >= b[2] and c[4] <= b[3] and c[5] >= b[4] and c[6] <= b[5] and b[2] <= b[3]
    want = sorted(c[2] for c in chars if not any(held(c, b) for b in boxes))
    c = spark.createDataFrame(chars, "doc int, page int, k int, x0 double, x1 double, top double, bottom double")
    b = spark.createDataFrame(boxes, "doc int, page int, x0 double, x1 double, top double, bottom double")
    out = files.outside(c, b)
    assert sorted(r["k"] for r in out.collect()) == want and 0 < len(want) < len(chars)
    assert files.outside(c, b.limit(0)).count() == len(chars)


def test_composition_and_splits_take_some_texts_at_a_time(spark):
    import itertools
    import unicodedata

    odd = ["e", "́", "̣", "ᄀ", "ᅡ", "ᆨ", "가", "Ω", "क़", "̈́", "и", "̆", "\U0001f600", "\U0001d15e", "\n", "​", "ে", "া", "퓛", "ẛ"]
    texts = ["".join(c) for n in (1, 2, 3) for c in itertools.product(odd, repeat=n)] + ["", None, "plain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.compose(F.col("t")).alias("c")).collect()
    wrong = [texts[r["k"]] for r in rows if r["c"] != (texts[r["k"]] if texts[r["k"]] is None else unicodedata.normalize("NFC", texts[r["k"]]))]
    assert not wrong and len(rows) == len(texts)
    # Plain and short texts don't reach Python, and of the others it never holds a whole batch.
    sent = spark.createDataFrame([("plain",)], "t string").select(text.compose(F.col("t")), chunk.split_column(F.col("t"), 800, 120))
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan.split("ArrowEvalPython")[1]
    assert max(text.ROWS, chunk.ROWS) <= 64 and files.BATCH * 4 <= files.TASK <= 16 << 20
