"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from functools import cache
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, filter_audit, line_dedup, minhash_dedup, nbsvm, packing, pieces, pii, quality_rules, replay, shards, url_filter


@cache
def vocabulary(name: str) -> bytes:
    """A public vocabulary file; only the driver reads it, the workers get its bytes."""
    return Path(public_tokenizers.path(name)).read_bytes()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    good = quality_rules.passes
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~good(quality_rules.POLICIES["base"])).alias("base_failed"), good(quality_rules.POLICIES["v1"]).alias("kept"), "failed")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "covered", "ends_crc32"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shuffled_shards(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", shards.record_size().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = nbsvm.score(docs, nbsvm.fit(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])
    return rows.select("doc_id", nbsvm.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.clean(_table(spark, sf_dir, "documents"), least_documents=10, least_length=1)
    return rows.select("in.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_cascading_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": op6_sharding,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_minhash": op10_minhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_cascading_release": op13_cascading_release,
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op2_sql() -> str:
    hosts = sorted(url_filter.HOST_RULES, key=lambda r: -len(r.host + r.path))
    fits = " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.host}{r.path}'" for r in hosts)
    says = " ".join(f"WHEN '{r.host}{r.path}' THEN '{r.verdict}'" for r in hosts)
    hit = " ".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.name}'" for r in url_filter.PATTERN_RULES)
    word = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in url_filter.PATTERN_RULES)
    return rf"""
WITH p AS (
  SELECT page_id, translate(url, '{_UPPER}', '{_LOWER}') AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (SELECT *, CASE {fits} END AS rule, CASE {hit} END AS pattern FROM p)
SELECT page_id, host, path, rule, coalesce(CASE rule {says} END, CASE pattern {word} END, 'allow') AS verdict, pattern
FROM r"""


def _op4_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(quality_rules.RULES))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win JOIN dup USING (rid, s)) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l,
         coalesce(cov.n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN cov ON cov.rid = d.rid),
n AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM m),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM n)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       failed & {quality_rules.mask_of(quality_rules.POLICIES["base"])} <> 0 AS base_failed,
       failed & {quality_rules.mask_of(quality_rules.POLICIES["v1"])} = 0 AS kept, failed
FROM f"""


_OP9_SQL = """
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
links AS (
  SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.9),
reach AS (SELECT id, id AS far FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.far = l.a),
root AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM nodes JOIN root USING (id) LEFT JOIN n USING (id)"""

_OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM d)
  UNION ALL SELECT id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
rare AS (SELECT g, count(*) AS f FROM s GROUP BY g HAVING count(*) > 1),
-- Sets that share 80 in 100 share one of the rarest fifth of either's shingles.
prefix AS (
  SELECT id, g FROM (SELECT s.id, s.g, n.n, row_number() OVER (PARTITION BY s.id ORDER BY coalesce(f, 1), s.g) AS r
                     FROM s JOIN n USING (id) LEFT JOIN rare USING (g)) WHERE r <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM prefix x JOIN prefix y ON x.g = y.g AND x.id < y.id),
pairs AS (SELECT a, b, count(*) AS c FROM cand JOIN s x ON x.id = a JOIN s y ON y.id = b AND y.g = x.g GROUP BY a, b),
one AS (SELECT a, b FROM pairs JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT id, id AS far FROM d UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.far = l.a),
root AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id)
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept
FROM d JOIN root USING (id) LEFT JOIN n USING (id)"""

_FAILS = " || ".join(
    f"CASE WHEN {c} THEN '{f}' ELSE '' END"
    for f, c in (
        ("A", "len(w) < 200"),
        ("B", "100 * len(list_distinct(w)) < 50 * len(w)"),
        ("C", "100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)"),
        ("D", "regexp_matches(t, '[#$%&*|]')"),
        ("E", "doc_id > min(doc_id) OVER (PARTITION BY t)"),
    )
)
_OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
f AS (SELECT doc_id, part, {_FAILS} AS fails FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(string_split('ABCDE', '')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
m AS (SELECT part, n, good, toxic, filter_order, step, filter_order[step] AS letter, contains(fails, filter_order[step]) AS own, fails = filter_order[step] AS sole,
             regexp_matches(fails, '[' || filter_order[:step - 1] || '-]') AS gone FROM c, s),
k AS (SELECT part, filter_order, step, letter,
             sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM m GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM k"""

_OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM x),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid"""


def _crc(values: str) -> str:
    """CRC-32 of a list of byte values, by the table ``tab``."""
    return f"xor(list_reduce({values}, lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


_HEX = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda y: ((strpos('0123456789ABCDEF', y[1]) - 1) * 16 + strpos('0123456789ABCDEF', y[2]) - 1)::BIGINT)"
_KEY = "list_transform(string_split(k || ':' || conv_id || ':' || turn, ''), lambda y: ord(y)::BIGINT)"
# The first attempt that delivers; null where none does.
_ATTEMPT = "list_filter(range(1, 7), lambda k: repair < 0 OR (start + 20 * (pow(2, k - 1) - 1) >= 7 * p + repair AND NOT f[k]))[1]"
_OP13_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS b, 0 AS k, b::BIGINT AS c FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tabs AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
t AS (SELECT row_number() OVER () AS rid, conv_id, turn, {_crc(_HEX)} AS crc FROM conversations, tabs),
h AS (SELECT rid, list({_crc(_KEY)} ORDER BY k) AS h FROM (SELECT rid, conv_id, turn, tab, unnest(range(9)) AS k FROM t, tabs) GROUP BY rid),
v AS (SELECT conv_id, turn, crc, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, crc) - 1) AS p, h[1] % 5 AS d,
             CASE WHEN h[2] % 101 < 50 THEN h[3] % 101 ELSE -1 END AS repair, list_transform(h[4:9], lambda x: x % 3 = 0) AS f FROM t JOIN h USING (rid)),
r AS (
  SELECT *, {_ATTEMPT} AS a FROM (SELECT *, 7 * p AS start, false AS blocked FROM v WHERE d = 0 OR d > p)
  UNION ALL
  SELECT *, {_ATTEMPT} AS a
  FROM (SELECT v.*, CASE WHEN NOT r.blocked AND r.a IS NOT NULL THEN greatest(7 * v.p, r.start + 20 * (pow(2, r.a - 1) - 1)::BIGINT) END AS start, r.blocked OR r.a IS NULL AS blocked
        FROM v JOIN r ON r.conv_id = v.conv_id AND r.p = v.p - v.d WHERE v.d > 0)),
o AS (SELECT conv_id, turn, p, crc, CASE WHEN blocked THEN 'blocked' WHEN a IS NULL THEN 'dead' ELSE 'delivered' END AS status,
             (CASE WHEN blocked THEN 0 ELSE coalesce(a, 6) END)::INT AS attempts, start AS first_at, CASE WHEN NOT blocked THEN (start + 20 * (pow(2, coalesce(a, 6) - 1) - 1))::BIGINT END AS last_at
      FROM r),
n AS (SELECT *, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY conv_id, status ORDER BY last_at, turn, p) END AS release_no FROM o)
SELECT conv_id, turn, status, attempts, first_at, last_at, release_no, (sum(release_no * crc) OVER (PARTITION BY conv_id, status ORDER BY release_no))::BIGINT AS state
FROM n"""

ORACLE_SQL = {
    "op2_url_filter": _op2_sql(),
    "op4_quality_rules": _op4_sql(),
    "op9_embedding_dedup": _OP9_SQL,
    "op10_minhash": _OP10_SQL,
    "op11_filter_audit": _OP11_SQL,
    "op12_line_dedup": _OP12_SQL,
    "op13_cascading_release": _OP13_SQL,
}
