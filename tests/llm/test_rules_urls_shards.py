import random
import re
import zlib
from collections import Counter

import duckdb
from millrace.llm import quality_rules, queries, shards, url_filter
from pyspark.sql import functions as F

from ..conftest import SF


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_measures(docs_of, odd_docs, no_docs):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "b", "cc", "é", "#", "|", " ", " ", "\n", "\t", "\r", "\x0b", "\xa0"]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    for docs in (docs_of(texts), odd_docs):
        own = sorted(map(tuple, quality_rules.ledger(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
        assert own == sorted(measured(r["text"]) for r in docs.collect())
    assert quality_rules.ledger(no_docs).count() == 0


def test_policies_and_ablation(docs_of):
    good = " ".join(f"word{i}" for i in range(80))
    docs = docs_of([good, "too short", "same " * 100, good + " ###" * 40, "sp#m " * 100])
    rows = quality_rules.ledger(docs)
    kept = {r["doc_id"] for r in rows.where(quality_rules.passes(quality_rules.POLICIES["v1"])).collect()}
    assert kept == {0}
    table = {r["rule"]: r for r in quality_rules.ablation(rows, quality_rules.POLICIES["v1"]).collect()}
    assert table["min_words"]["failing_alone"] == 1 and table["min_words"]["kept_without"] == 2
    assert table["symbols"]["failing"] == 2 and table["symbols"]["kept_without"] == 2


def test_keep_good_holds_clashing_columns(docs_of):
    docs = docs_of([" ".join(f"w{i}" for i in range(60)), None]).withColumn("failed", F.lit("x")).withColumn("n_words", F.lit(7)).withColumn("_row", F.lit(1))
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and [(r["doc_id"], r["failed"], r["n_words"]) for r in out.collect()] == [(0, "x", 7)]


def test_index_finds_what_all_rules_find():
    rnd = random.Random(5)
    bits = ["http://", "https://", "ads", "track", "casino", "login", "x", "EDU", ".", "/", "?", "#", "-", "feed", "format", "=", "rss", "&", "phpsessid", "é"]
    index = url_filter.PatternIndex(url_filter.PATTERN_RULES, {"feed": 100, "format": 5, "rss": 9})
    assert index.by_token["format"] and "feed" not in index.by_token
    for _ in range(20000):
        url = "".join(rnd.choice(bits) for _ in range(rnd.randrange(10)))
        first = next((r for r in url_filter.PATTERN_RULES if re.search(r.pattern, url.translate(url_filter._ASCII))), None)
        assert index.judge(url)[:2] == ((first.name, first.verdict) if first else (None, "allow")), url


def test_index_finds_tokens_that_end_longer_ones():
    ends = url_filter.PatternRule("ends", "block", "format=[^&]")
    assert url_filter.PatternIndex([ends], {}).judge("http://a.org/feed?dateformat=rss")[0] == "ends"
    assert url_filter.PatternIndex([ends], {}).judge("http://a.org/feed?formatted=rss")[0] is None
    for rarity in ({"feed": 431}, {"format": 9, "rss": 9}, {"feed": 1, "format": 1}):
        index = url_filter.PatternIndex(url_filter.PATTERN_RULES, rarity)
        assert index.judge("http://a.org/feed?dateformat=rss")[:2] == ("feed", "block")
        assert index.judge("http://a.org/feed?formatted=rss")[:2] == (None, "allow")


def test_tokens_are_read_off_the_expressions(spark, tmp_path):
    known = {r.name: url_filter.literal_tokens(r.pattern) for r in url_filter.PATTERN_RULES}
    assert known["feed"] == [("feed", True), ("format", False), ("rss", True)] and known["login"] == [("login", True)]
    for pattern, want in {"abc": [], "^abc$": [("abc", True)], "/abc[0-9]?/": [], "(abc)/": [], "a/b+/c/": [("a", False), ("c", True)], "/x(y|z)": [], "[^a]f/": [("f", False)], "/f[^a-z]": [], r"/f\b": [], "/f(/|)": [], "/f(/|$)": [("f", True)], "/f(?=/)": []}.items():
        assert url_filter.literal_tokens(pattern) == want, pattern
    # Random expressions: whatever one matches holds its tokens, as runs or as the ends of runs.
    rnd = random.Random(17)
    parts = ["ab", "cd", "x", "1", "/", r"\.", "[^/]*", "[a-c]", "(ab|/)", "(/|$)", "c?", "/?", "[?#]", "a+", "^", "[^a-z0-9]"]
    texts = ["".join(rnd.choice(["ab", "cd", "x", "1", "/", ".", "a", "c", "?", "#", "z"]) for _ in range(rnd.randrange(8))) for _ in range(1500)]
    for _ in range(1500):
        rule = url_filter.PatternRule("r", "block", "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6))))
        for token in rule.tokens:
            index = url_filter.PatternIndex([rule], {t: int(t != token) for t in rule.tokens})
            for text in rnd.sample(texts, 40):
                assert (index.judge(text)[0] == "r") == bool(text and re.search(rule.pattern, text)), (rule.pattern, token, text)
    (tmp_path / "rules").write_text("# a list\n\nshop block [.-]shop[.-]\nschool allow /school /x y\n")
    rules = url_filter.load_rules(spark, f"file://{tmp_path}/rules")
    assert [(r.name, r.verdict, r.pattern, r.tokens) for r in rules] == [("shop", "block", "[.-]shop[.-]", ("shop",)), ("school", "allow", "/school /x y", ("school", "x"))]


def test_a_long_rule_list(spark, tmp_path):
    rnd = random.Random(19)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 5)))
    shapes = ["[.-]{}[.-]", "/{}/", "{}=", "/{}/?([?#]|$)", "://[^/?#]*{}[.]", "/{}[^/]*/{}/"]
    lines = [f"r{k} {rnd.choice(['allow', 'block'])} {shape.format(word(), word())}" for k, shape in enumerate(rnd.choice(shapes) for _ in range(4000))]
    (tmp_path / "rules").write_text("\n".join(lines))
    rules = url_filter.load_rules(spark, f"file://{tmp_path}/rules")
    urls = [f"http://{word()}.{word()}-{word()}.org/{word()}/x{word()}/{word()}?{word()}=1&{word()}{word()}={word()}" for _ in range(150)] + [None, ""]
    rows = url_filter.match_patterns(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, keep=["page_id"]).collect()
    compiled, tried = [(r.name, re.compile(r.pattern)) for r in rules], 0
    for r in rows:
        url = urls[r["page_id"]]
        assert r["pattern"] == next((n for n, p in compiled if url and p.search(url)), None), url
        tried += r["tried"]
    # A few of the rules run for a URL, not all.
    assert len(rules) == 4000 and tried < 0.05 * len(urls) * len(rules)


def test_urls(spark):
    urls = {
        "http://WWW.Example.com/en/x?a": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://a.example.com/de/#t": ("a.example.com", "/de/", "com/", "allow"),
        "http://x.net/fr/1": ("x.net", "/fr/1", "net/fr/", "block"),
        "http://x.net/frog": ("x.net", "/frog", None, "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://ads.shop.org/": ("ads.shop.org", "/", None, "block"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d?e://f": ("b:", "//c/d", None, "allow"),
        "http://" + "x" * 20000 + ".net/es/": ("x" * 20000 + ".net", "/es/", "net/es/", "block"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert url_filter.judge_urls(df.where("page_id < 0")).count() == 0


def test_sql_twins(spark):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        rows = queries.QUERIES[name](spark, SF)
        names = sorted(rows.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rows.select(*names).collect()), name


def test_shards(spark, odd_docs, no_docs):
    docs = odd_docs.union(odd_docs).union(odd_docs)
    rows = shards.shuffled_shards(docs, n_shards=7, bucket_bytes=60_000).collect()
    by = Counter(r["shard"] for r in rows)
    assert sum(by.values()) == docs.count() and max(by.values()) - min(by[s] for s in range(7)) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in rows) == sorted((repr(r["doc_id"]), repr(r["text"])) for r in docs.collect())
    assert shards.shuffled_shards(no_docs).count() == 0


def test_shards_are_seeded_and_mixed(spark, docs_of, tmp_path):
    docs = docs_of([f"text {i}" for i in range(500)]).repartition(3)
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    place = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.shuffled_shards(docs, seed=seed).collect()}
    one = place(1)
    assert one == place(1) and one != place(2)
    order = [d for d, _ in sorted(one.items(), key=lambda x: x[1])]
    assert order != sorted(order) and abs(sum(order[:250]) / 250 - 249.5) < 40
    out = queries.op6_sharding(spark, SF).collect()
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in out)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 16 for r in out)
    by = Counter(r["shard"] for r in out)
    assert sorted(by) == list(range(40)) and max(by.values()) - min(by.values()) <= 1 and Counter(r["doc_id"] for r in out) == Counter(text.keys())
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(40) for k in range(by[s])]
    clash = spark.read.parquet(f"{tmp_path}/d").withColumnsRenamed({"lang": "_bucket", "source": "file", "n_chars": "row"})
    assert shards.shuffled_shards(clash, columns=["doc_id", "text", "_bucket", "file", "row"]).count() == 500
    shards.write_shards(shards.shuffled_shards(docs, n_shards=4), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().count() == 4
