"""DuckDB SQL shared by the oracle queries."""

from __future__ import annotations

from millrace.config import ARTICLE_PATTERNS
from millrace.functions import text
from millrace.operators import agent, chunk, models

#: Queries of the examples; "qqqq" is in no text.
ASKED = [(1, "thereon the eaux standing"), (2, "qqqq"), (3, "Thoran qqqq Thoran"), (4, "...")]
ABC = "abcdefghijklmnopqrstuvwxyz"
CYR = ("abvgdeziyklmnoprstufx", "абвгдезийклмнопрстуфх")
NODES = ["contextualize", "retrieve", "grade_docs", "rewrite_query", "generate", "grade_hallucination", "grade_answer", "finalize"]
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DOCS = "SELECT doc_id AS key, text, lang, source AS department, CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'confidential' END AS access_level FROM documents"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tok(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_ʻ'']+'), lambda t: lower(t))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_WS}]+'), lambda w: w <> '')"


# Retrieval -----------------------------------------------------------------------

BM25 = f"""
dl AS MATERIALIZED (SELECT doc_id AS key, len({tok("coalesce(text, '')")})::BIGINT AS dl FROM documents),
st AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS MATERIALIZED (SELECT term, key, count(*) AS tf FROM (SELECT doc_id AS key, unnest({tok("coalesce(text, '')")}) AS term FROM documents) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, st),
mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raws),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raws, mean)"""


def asked(*ids: int) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(q)})" for i, q in ASKED if i in ids) + ") AS q(query_id, query)"


PASSAGES = "SELECT item_id::INT AS query_id, text AS query FROM benchmark"


def bm25_top(queries: str, k: int, allowed: str = "true") -> str:
    return f"""
WITH {BM25},
q AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({tok("query")}) AS term FROM q) GROUP BY ALL),
sc AS (
  SELECT query_id, post.key, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
  FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl ON dl.key = post.key, st GROUP BY ALL),
everything AS (
  SELECT q.query_id, d.key, round(coalesce(s, 0), 6) AS score
  FROM (SELECT DISTINCT query_id FROM qt) q, ({DOCS}) d LEFT JOIN sc ON sc.query_id = q.query_id AND sc.key = d.key WHERE {allowed}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM everything)
SELECT query_id::INT AS query_id, key, score, rank::INT AS rank FROM ranked WHERE rank <= {k}"""


_SNAP = "snap AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN text || ' thereon thereon' ELSE text END AS text, source, lang FROM documents WHERE doc_id % 10 <> 7)"
SEGMENTS = f"""
WITH {_SNAP}, found AS ({bm25_top(asked(1, 2, 3, 4), 10).replace("documents", "snap")})
SELECT *, unnest(['segments', 'compacted']) AS form FROM found"""


def vector_top(which: str, k: int, allowed: str = "true") -> str:
    return f"""
WITH q AS (SELECT vec_id::INT AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE {which}),
s AS (SELECT query_id, vec_id AS key, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE {allowed}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s)
SELECT query_id, key, score, rank::INT AS rank FROM r WHERE rank <= {k}"""


LEGS = f"""
vec AS ({vector_top("vec_id = 0", 20)}),
lex AS ({bm25_top(asked(1), 20)}),
legs AS (SELECT 1::INT AS query_id, key, 'vector' AS source, rank, score FROM vec UNION ALL SELECT 1::INT, key, 'bm25', rank, score FROM lex),
sums AS (SELECT query_id, key, round(sum(1 / (60 + rank)), 10) AS score, min(rank) FILTER (source = 'vector') AS v, min(rank) FILTER (source = 'bm25') AS b FROM legs GROUP BY ALL),
fused AS (SELECT query_id, key, score, row_number() OVER (ORDER BY score DESC, v ASC NULLS LAST, b ASC NULLS LAST, key) AS rank FROM sums)"""

LEGS_BATCH = f"""
qs AS (SELECT doc_id::INT AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
vec AS ({vector_top("vec_id % 100 = 0", 20)}),
lex AS ({bm25_top("SELECT * FROM qs", 20)}),
legs AS (SELECT query_id, key, 'vector' AS source, rank, score FROM vec UNION ALL SELECT query_id, key, 'bm25', rank, score FROM lex),
sums AS (SELECT query_id, key, round(sum(1 / (60 + rank)), 10) AS score, min(rank) FILTER (source = 'vector') AS v, min(rank) FILTER (source = 'bm25') AS b FROM legs GROUP BY ALL),
fused AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v ASC NULLS LAST, b ASC NULLS LAST, key) AS rank FROM sums)"""

RERANK_BATCH = f"""{LEGS_BATCH},
hits AS (SELECT f.query_id, f.key, f.score AS hybrid_score, f.rank AS hybrid_rank, query, d.text FROM fused f JOIN qs USING (query_id) JOIN documents d ON d.doc_id = f.key WHERE f.rank <= 10 AND len({tok("query")}) > 0),
scored AS (SELECT *, round(len(list_intersect(list_distinct({tok("query")}), {tok("text")})) / len(list_distinct({tok("query")})), 6) AS score FROM hits),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hybrid_rank) AS rank FROM scored)"""

RERANK = f"""{LEGS},
hits AS (SELECT f.query_id, f.key, f.score AS hybrid_score, f.rank AS hybrid_rank, d.text FROM fused f JOIN documents d ON d.doc_id = f.key WHERE f.rank <= 10),
scored AS (SELECT *, round(len(list_intersect(list_distinct({tok(quoted(ASKED[0][1]))}), {tok("text")})) / len(list_distinct({tok(quoted(ASKED[0][1]))})), 6) AS score FROM hits),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hybrid_rank) AS rank FROM scored)"""

_FIRST = quoted(ASKED[0][1])
CACHED = f"""
WITH p AS (SELECT doc_id, doc_id % 3 <> 0 AS later, round(len(list_intersect(list_distinct({tok(_FIRST)}), {tok("text")})) / len(list_distinct({tok(_FIRST)})), 6) AS score FROM documents),
n AS (SELECT count(*) FILTER (NOT later) AS a, count(*) FILTER (later) AS b FROM p),
c AS (SELECT *, a - 75 * ceil(greatest(0, a - 300) / 75) AS held FROM n),
e AS (SELECT *, held + b - 75 * ceil(greatest(0, held + b - 300) / 75) AS live FROM c),
s AS (SELECT *, row_number() OVER (ORDER BY later, doc_id) - 1 AS seq FROM p)
SELECT lower({_FIRST}) AS query, doc_id::VARCHAR AS key, score, seq FROM s, e WHERE seq >= a + b - live"""

STAGES = f"""WITH {RERANK}
SELECT 0::INT AS place, 'vector' AS stage, 1::INT AS query_id, rank::INT AS rank, key, score FROM vec WHERE rank <= 5
UNION ALL SELECT 1::INT, 'bm25', query_id, rank::INT, key, score FROM lex WHERE rank <= 5
UNION ALL SELECT 2::INT, 'hybrid', query_id, rank::INT, key, score FROM fused WHERE rank <= 5
UNION ALL SELECT 3::INT, 'reranked', query_id, rank::INT, key, score FROM reranked WHERE rank <= 5"""

READERS = ("src1", "src2", "general")
_READER = f"CASE q.query_id % 10 {' '.join(f'WHEN {i} THEN {quoted(r)}' for i, r in enumerate(READERS))} END"
_BY_READER = f"SELECT query_id * 10 + reader AS query_id, query FROM ({asked(1, 2, 3)}), (SELECT unnest(range({len(READERS)}))::INT AS reader)"
ACCESS_TOP = f"""
SELECT query_id, key, score, rank, source AS department FROM ({bm25_top(_BY_READER, 3, f"department IN ({_READER}, 'general') AND access_level IN ('public', 'internal')")})
JOIN documents ON doc_id = key"""

# A value that looks like a name is not filled in again.
_TEMPLATE = quoted(models.PROMPTS["relevant"].replace("{{", "{").replace("}}", "}"))
PROMPTED = f"SELECT conv_id, turn, sha256(replace(replace({_TEMPLATE}, '{{query}}', text), '{{passage}}', text || ' {{query}}')) AS sha FROM conversations WHERE role = 'user'"

# Text ------------------------------------------------------------------------------


def dirty(x: str) -> str:
    return f"(chr(65279) || ' ' || replace(replace({x}, '. ', '.' || chr(8203) || '  ' || chr(9)), 'e' || chr(10), 'e-' || chr(10) || ' ') || repeat(chr(10), 5) || 'e' || chr(769) || '  ')"


def clean(x: str) -> str:
    x = f"nfc_normalize({x})"
    for pattern, by in ((r"[\x{200b}-\x{200f}\x{feff}]", "''"), (rf"-[{_WS}]*\n[{_WS}]*", "''"), (r"[ \t]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return strip(x)


def cyr(x: str) -> str:
    return f"translate(lower({x}), '{CYR[0]}', '{CYR[1]}')"


def only_cyr(x: str) -> str:
    return f"regexp_replace({cyr(x)}, '[A-z]', '', 'g')"


def russian(x: str) -> str:
    return f"replace({only_cyr(x)}, 'о', 'ы')"


def dirty_cyr(x: str) -> str:
    return f"replace({dirty(only_cyr(x))}, 'e', 'е')"


def script(x: str) -> str:
    n = lambda p: f"len(regexp_extract_all(left({x}, 500), '{p}'))"
    c, a, r = n(r"[\x{400}-\x{4ff}]"), n("[A-z]"), n(f"[{text.RU_MARKERS}]")
    marked = f"regexp_matches(left({x}, 500), '{'|'.join(text.UZ_LATIN_MARKERS)}')"
    return f"(CASE WHEN {c} = 0 AND {a} > 0 THEN (CASE WHEN {marked} THEN 'uz-latn' ELSE 'en' END) WHEN {a} = 0 AND {c} > 0 THEN (CASE WHEN {r} > 0.02 * {c} THEN 'ru' ELSE 'uz-cyrl' END) ELSE 'mixed' END)"


def letters(x: str) -> str:
    return f"({cyr(x)} || translate({cyr(x)}, '{CYR[1]}', '{CYR[1].upper()}') || 'ШшЧчЮюЯяЁёЎўҒғҲҳҚқЪъЫыЭэЬьЩщ')"


def latin(x: str) -> str:
    for letter, two in text.CYRL_DOUBLE.items():
        x = f"replace({x}, '{letter}', '{two}')"
    return f"translate({x}, '{text.CYRL_SINGLE[0]}', '{text.CYRL_SINGLE[1]}')"


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"

PARAGRAPHS = f"""
WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, p, length(p) + 1 AS n FROM (SELECT doc_id, i, {strip("x")} AS p FROM ({_LINES})) WHERE p <> ''),
r AS (
  SELECT doc_id, i, p, n AS run, n AS total, 0 AS block FROM p WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, p.p, CASE WHEN r.run >= 1500 THEN p.n ELSE r.run + p.n END, r.total + p.n, r.block + (r.run >= 1500)::INT
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
g AS (SELECT doc_id, block, string_agg(p, chr(10) ORDER BY i) AS content, max(total) AS total FROM r GROUP BY ALL)
SELECT doc_id, block::INT AS block, sha256(content) AS sha, length(content)::INT AS n, greatest(1, total // 1500)::INT AS page FROM g"""

LEGAL = f"""
lines AS (SELECT doc_id, i, (CASE WHEN i % 5 = 0 THEN 'Ilova ' || i || ' ' ELSE i || '-modda. ' END) || x AS line FROM ({_LINES})),
heads AS (
  SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
         left({strip("regexp_extract(line, '^[^.—:-]*')")}, 40) AS label
  FROM lines)"""


HEADS = (
    "", "12-modda. ", "3-MODDA ", "Статья 5. ", "7 СТАТЬЯ ", "Article 9: ", "2-bob. ", "article 41 ", "Глава 3. ", "IV BOʻLIM ", "x boʻlim ",
    "no heading ", "V BO'LIM ", "\n \n12. a", "\t7. Ў", "Ilova 2 ", "3-ILOVA ", "8-ilova ", "Приложение 4 ", "1234. B",
)
_HEADING = "(?mi)" + "|".join(p if p.startswith("^") else f"^{p}" for p in ARTICLE_PATTERNS).replace(r"\s", f"[{_WS}]").replace(r"\d", r"\p{Nd}").replace("'", "''")
_LABEL = strip("regexp_extract(" + strip("regexp_extract(p, '^[^\n]*')") + ", '^[^.—:-]*')")
HEADINGS = f"""
WITH t AS (SELECT doc_id, string_agg([{", ".join(map(quoted, HEADS))}][(i - 1 + doc_id) % {len(HEADS)} + 1] || x, chr(10) ORDER BY i) AS t FROM ({_LINES}) GROUP BY 1),
s AS (SELECT doc_id, string_split(regexp_replace(t, '{_HEADING}', chr(64976) || '\\0', 'g'), chr(64976)) AS p FROM t),
e AS (SELECT doc_id, len(p) AS parts, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM s),
o AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS off FROM e)
SELECT doc_id, off, CASE WHEN i > 1 THEN left({_LABEL}, 40) END AS label, sha256(CASE WHEN parts = 1 THEN p ELSE {strip("p")} END) AS sha
FROM o WHERE (CASE WHEN parts = 1 THEN p ELSE {strip("p")} END) <> ''"""


def pieces(rows: str, size: int = 800, overlap: int = 120) -> str:
    """CTEs up to pieces (id, piece, content) of rows (id, text): split, merge, and split what is too long more finely.

    One level a separator. path is the way to a part through the levels, and orders what comes out.
    """
    levels = [f"t0 AS (SELECT id, []::BIGINT[] AS path, text FROM src WHERE length(text) > {size})"]
    for k, mark in enumerate(chunk.SEPARATORS):
        here = f"contains(text, {_char(mark)})" if mark else "true"
        parts = f"list_filter(list_transform(string_split(text, {_char(mark)}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {_char(mark)} || p END), lambda p: p <> '')" if mark else "string_split(text, '')"
        levels.append(f"s{k} AS (SELECT id, path, unnest(p) AS p, generate_subscripts(p, 1)::BIGINT AS i FROM (SELECT id, path, {parts} AS p FROM t{k} WHERE {here}))")
        levels.append(f"r{k} AS (SELECT *, sum((length(p) >= {size})::INT) OVER (PARTITION BY id, path ORDER BY i) AS g FROM s{k})")
        levels.append(f"m{k} AS (SELECT id, list_append(path, min(i)) AS path, list(p ORDER BY i) AS parts FROM r{k} WHERE length(p) < {size} GROUP BY id, path, g)")
        levels.append(f"t{k + 1} AS (SELECT id, list_append(path, i) AS path, p AS text FROM r{k} WHERE length(p) >= {size} UNION ALL SELECT id, path, text FROM t{k} WHERE NOT {here})")
    runs = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(len(chunk.SEPARATORS)))
    joined = strip("array_to_string(a.run, '')")
    # What of a run is kept as overlap: the longest tail that is short enough for itself and beside the next part.
    rest = "list_sum(list_transform(a.run[j + 1:], lambda x: length(x)))"
    tail = f"a.run[list_filter(range(0, len(a.run) + 1), lambda j: coalesce({rest}, 0) = 0 OR ({rest} <= {overlap} AND {rest} + e.total <= {size}))[1] + 1:]"
    full = f"len(a.run) > 0 AND a.total + e.total > {size}"
    step = f"CASE WHEN {full} THEN {{'done': list_append(a.done, {joined}), 'run': list_concat({tail}, e.run), 'total': coalesce(list_sum(list_transform({tail}, lambda x: length(x))), 0)::BIGINT + e.total}} ELSE {{'done': a.done, 'run': list_concat(a.run, e.run), 'total': a.total + e.total}} END"
    fold = f"list_reduce(list_transform(parts, lambda p: {{'done': []::VARCHAR[], 'run': [p], 'total': length(p)::BIGINT}}), lambda a, e: {step})"
    return f"""
src AS MATERIALIZED ({rows}), {", ".join(levels)},
folded AS (SELECT id, path, {fold} AS a FROM ({runs})),
listed AS (SELECT id, path, list_filter(list_append(a.done, {joined}), lambda x: x <> '') AS p FROM folded),
each AS (SELECT id, path, unnest(p) AS content, generate_subscripts(p, 1) AS i FROM listed),
pieces AS (
  SELECT id, 0::INT AS piece, text AS content FROM src WHERE length(text) <= {size}
  UNION ALL SELECT id, (row_number() OVER (PARTITION BY id ORDER BY path, i) - 1)::INT, content FROM each)"""


def _char(mark: str) -> str:
    return "(" + " || ".join("chr(10)" if c == "\n" else quoted(c) for c in mark) + ")" if mark else "''"


CHUNKS = f"""
WITH {LEGAL},
ctx AS (SELECT *, last_value(CASE WHEN lower(label) LIKE '%ilova%' THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY off) AS ctx FROM heads),
segs AS (SELECT doc_id, off, {strip("line")} AS text, row_number() OVER () AS id, CASE WHEN ctx IS NULL OR lower(label) LIKE '%ilova%' THEN label ELSE ctx || ' / ' || label END AS article_label FROM ctx),
hashes AS (SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS file_hash FROM lines GROUP BY 1),
{pieces("SELECT id, text FROM segs")},
c AS (SELECT s.doc_id, off, piece, {strip("content")} AS content, article_label FROM pieces JOIN segs s USING (id)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY off, piece) - 1 AS n FROM c WHERE length(content) >= 30)
SELECT printf('%s_%04d', file_hash[1:8], n) AS chunk_id, content, doc_id::VARCHAR AS source_path, doc_id::VARCHAR AS filename, file_hash, 1::INT AS page, 'text' AS kind,
       article_label, 'en' AS language_hint, greatest(1, length(content) // 4)::INT AS token_estimate
FROM n JOIN hashes USING (doc_id)"""

# Files and the index over them: twenty documents of a source a file, some of them no DOCX although named so.
_FILES = """
f AS (SELECT coalesce(source, 'none') AS source, (doc_id // 20)::BIGINT AS no, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY ALL),
g AS (SELECT *, source || '/' || no || (CASE WHEN no % 10 = 1 THEN '.docx' ELSE '.txt' END) AS file FROM f)"""
FILES_READ = f"""
WITH {_FILES}, c AS (SELECT *, {clean("t")} AS c FROM g)
SELECT file, sha256(t) AS file_hash, no % 10 = 1 AS failed, (CASE WHEN no % 10 = 1 THEN 0 ELSE 1 END)::INT AS total_pages, (CASE WHEN no % 10 = 1 OR c = '' THEN 0 ELSE 1 END)::INT AS n_blocks,
       CASE WHEN no % 10 = 1 THEN 'mixed' ELSE {script("c")} END AS language_hint, CASE WHEN no % 10 <> 1 AND c <> '' THEN sha256(c) END AS sha
FROM c"""
LIFE_CYCLE = f"""
WITH {_FILES},
o AS (SELECT file, sha256(t) AS old_hash FROM g WHERE no % 10 NOT IN (1, 3)),
n AS (SELECT file, no % 10 = 1 AS failed, CASE WHEN no % 10 = 5 THEN t || 'One line more stands at the end of this file.' ELSE t END AS t FROM g WHERE no % 10 <> 7),
a AS (SELECT file, CASE WHEN old_hash IS NULL THEN 'new' WHEN t IS NULL THEN 'deleted' WHEN sha256(t) = old_hash THEN 'unchanged' ELSE 'changed' END AS status, CASE WHEN NOT failed THEN sha256(t) END AS file_hash FROM o FULL JOIN n USING (file)),
p AS (SELECT file, string_split(regexp_replace(c, '{_HEADING}', chr(64976) || '\\0', 'g'), chr(64976)) AS p FROM (SELECT file, {clean("t")} AS c FROM n WHERE NOT failed)),
s AS (SELECT file, text, row_number() OVER () AS id FROM (SELECT file, {strip("unnest(p)")} AS text FROM p) WHERE text <> ''),
{pieces("SELECT id, text FROM s")},
k AS (SELECT file, count(*) AS n FROM s JOIN pieces USING (id) WHERE length({strip("content")}) >= 30 GROUP BY 1)
SELECT file, status, file_hash, CASE WHEN file_hash IS NOT NULL THEN coalesce(n, 0)::INT END AS chunk_count, coalesce(n, 0) AS n_chunks, coalesce(n, 0) AS n_vectors FROM a LEFT JOIN k USING (file)"""

# Conversations, grading ------------------------------------------------------------


def followup(x: str) -> str:
    q = f"lower({strip(x)})"
    marks = ", ".join(map(quoted, agent.FOLLOWUP_WORDS))
    opens = " OR ".join(f"starts_with({q}, {quoted(s)})" for s in agent.FOLLOWUP_STARTS)
    return f"(len({words(q)}) < 6 OR list_has_any({words(q)}, [{marks}]) OR {opens})"


GATES = f"""
WITH h AS (
  SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w, '') AS last_user,
         list(CASE WHEN role = 'user' THEN lower({strip("text")}) END) OVER w AS earlier
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE turn % 5 WHEN 0 THEN translate(text, '{ABC}', '{ABC.upper()}') WHEN 1 THEN 'ab' WHEN 2 THEN {strip("last_user")} WHEN 3 THEN 'entirely other words stand here' ELSE text || ' more' END AS new FROM h),
b AS (SELECT *, list_distinct({words("lower(text)")}) AS bef, list_distinct({words("lower(new)")}) AS aft FROM n),
r AS (
  SELECT *, CASE WHEN lower(new) = lower({strip("text")}) THEN 'verbatim' WHEN length(new) < 5 THEN 'empty' WHEN list_contains(earlier, lower(new)) THEN 'collapsed'
    WHEN (CASE WHEN len(bef) = 0 THEN 1 ELSE len(list_intersect(bef, aft)) / len(bef) END) < 0.2 AND len(aft) > 3 THEN 'drifted' END AS reason FROM b)
SELECT conv_id, turn, reason, CASE WHEN reason IS NULL THEN new WHEN last_user <> '' THEN text || ' ({agent.JOINED_WITH}: ' || last_user || ')' ELSE text END AS final FROM r"""

ROUTES = f"""
SELECT *, CASE node
  WHEN 'grade_docs' THEN CASE WHEN n_relevant >= 1 THEN 'generate' WHEN rewrites < 2 THEN 'rewrite_query' ELSE 'finalize_no_docs' END
  WHEN 'generate' THEN CASE WHEN high THEN 'finalize' ELSE 'grade_hallucination' END
  WHEN 'grade_hallucination' THEN CASE WHEN grounded THEN 'grade_answer' WHEN generations < 3 THEN 'generate' ELSE 'finalize_gen_limit' END
  WHEN 'grade_answer' THEN CASE WHEN NOT answers AND rewrites < 2 THEN 'rewrite_query' ELSE 'finalize' END
  WHEN 'contextualize' THEN 'retrieve' WHEN 'retrieve' THEN 'grade_docs' WHEN 'rewrite_query' THEN 'retrieve' ELSE 'end' END AS following
FROM (SELECT conv_id, turn, {NODES}[k % 8 + 1] AS node, (k // 8 % 3)::INT AS n_relevant, (k // 24 % 4)::INT AS rewrites, (k // 96 % 5)::INT AS generations,
             k // 7 % 3 = 1 AS high, k // 3 % 2 = 1 AS grounded, k // 5 % 2 = 1 AS answers
      FROM (SELECT *, conv_id * 8 + turn AS k FROM conversations))"""

VERDICTS = r"""
WITH s AS (SELECT event_id, event_id % 6 AS n, event_type, '{"relevant": "yes", "reason": "' || event_type || '"}' AS said FROM events),
r AS (
  SELECT event_id, CASE n WHEN 0 THEN said WHEN 1 THEN '```json' || chr(10) || replace(said, 'yes', 'no') || chr(10) || '```' WHEN 2 THEN replace(said, 'yes', 'maybe')
    WHEN 3 THEN said || ' ' || said WHEN 4 THEN replace(said, event_type, repeat('x', 301)) ELSE event_type END AS reply FROM s),
j AS (SELECT event_id, regexp_extract(reply, '(?s)\{.*\}') AS j FROM r),
v AS (SELECT event_id, CASE WHEN j <> '' AND json_valid(j) THEN j END AS j FROM j)
SELECT event_id, coalesce(CASE WHEN json_extract_string(j, '$.relevant') IN ('yes', 'no') AND length(json_extract_string(j, '$.reason')) <= 300 THEN json_extract_string(j, '$.relevant') END, 'no') AS verdict FROM v"""
