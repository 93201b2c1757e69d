"""Lines that many documents share, dropped everywhere.

Lines are split off and brought to a key (stripped, A-Z lower-cased); of each
keyed line only a 128-bit hash, its document and its place travel. Keys found in
enough distinct documents come back to the places where they stand, by a join
that broadcasts the few heaviest keys and shuffles the others; the places of each
document then meet its text once, and the lines between dropped places are
joined again in their order.

Defined results: a null or empty text is one empty line. Empty keys stay. Rows
that share an id are one document when keys are counted, and so are all rows
without an id; each row gets its own result. An empty table gives no rows. All
columns of the input come back as they are, whatever their names, in ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spread import spread
from millrace.llm.common import addressed, dropped, join_unique, settled, written

_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """What lines are compared by."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _let(value: Column, body) -> Column:
    """body applied to value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """A row for each line whose key is long enough: hash (h1, h2), id, address and place. docs: settled."""
    rows = addressed(docs, F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("t"))
    keys = spread(rows).select("id", "file", "row", F.posexplode(F.transform(_lines(F.col("t")), line_key)).alias("at", "key"))
    return keys.where(F.length("key") >= least_length).select(F.xxhash64(F.lit(1), F.col("key")).alias("h1"), F.xxhash64(F.lit(2), F.col("key")).alias("h2"), "id", "file", "row", "at")


def frequent_keys(lines: DataFrame, least_documents: int) -> DataFrame:
    """The keys (h1, h2) found in enough distinct documents, with their numbers of lines and documents."""
    # Pairs of key and document are thinned out first, so a line of very many documents is many groups.
    pairs = lines.groupBy("h1", "h2", F.coalesce("id", F.lit("")).alias("id"), F.col("id").isNull().alias("nameless")).agg(F.count("*").alias("n"))
    return pairs.groupBy("h1", "h2").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_documents)


def _kept(lines: Column, places: Column) -> Column:
    """lines without those at the sorted places: the runs between them, one after the other."""
    ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    return _let(ends, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.slice(lines, e[k] + 2, e[k + 1] - e[k] - 1))))


def clean(docs: DataFrame, least_documents: int = 10, least_length: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """in (a struct of the input row's columns), n_lines, n_dropped and kept (the text without dropped lines) for each row."""
    docs = settled(docs)
    lines = written(keyed_lines(docs, id_col, text_col, least_length), "lines")
    frequent = written(frequent_keys(lines, least_documents).select(F.struct("h1", "h2").alias("h"), F.col("n_lines").alias("n")), "frequent")
    hits = join_unique(lines.select(F.struct("h1", "h2").alias("h"), "file", "row", "at"), frequent, "h", "n")
    places = written(hits.groupBy("file", "row").agg(F.sort_array(F.collect_list("at")).alias("places")), "places")  # of one text
    dropped(lines, frequent)
    rows = addressed(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("in"))
    # Only the numbers of a row's dropped lines meet its text; texts move once and are split once.
    met = rows.hint("merge").join(places, ["file", "row"], "left")
    split = met.select("in", "places", _lines(F.col("in").getField(text_col)).alias("lines"))
    result = F.struct(
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("places").isNull(), F.col("lines")).otherwise(_let(F.col("lines"), lambda x: _kept(x, F.col("places")))), "\n").alias("kept"),
    )
    return split.select("in", F.inline(F.array(result)))


def drop_lines(docs: DataFrame, least_documents: int = 10, least_length: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the shared lines dropped from their texts; all columns as they are. Null texts stay null."""
    out = clean(docs, least_documents, least_length, id_col, text_col)
    columns = [F.when(F.col("in").getField(c).isNotNull(), F.col("kept")).alias(c) if c == text_col else F.col("in").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns)
