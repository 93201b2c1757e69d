"""What each filter of a cascade removes, in every order of the filters.

Every document is measured once. Its failures are one mask, bit k for filter k,
and documents with the same part and mask are one cell of counts; from there on
the work depends on the number of cells alone. Cells are unpivoted against the
steps of every order: within a cell and an order, a running bit-or over the
steps before tells whether the document was gone already. Conditional sums over
the cells give the counts of a step, and a window over all orders a filter's
total.

Whether a text is a copy is found by digest (SHA-256): the smallest id of each
digest is joined back by digest and id, so that a text that many rows share
gathers nowhere.

Defined results: a null or empty text has no words and no characters. A null
part is the empty string. Rows that share id, text and part are one row with a
count; rows of one id and text are no copies of each other, and a row without an
id is nobody's copy and has no label. Of several labels of an id, one that says
so is enough. Columns other than the named ones are not read, and may have any
name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.spread import spread
from millrace.llm.common import dropped, written

SPACE = r"[\x20\x09-\x0D]"
_TRIM = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Filter:
    """A filter fails a document where its condition over the measures holds."""

    letter: str
    fails: str  # SQL over n_words, n_distinct, n_chars, n_upper, n_marks, is_copy


FILTERS: tuple[Filter, ...] = (
    Filter("A", "n_words < 200"),
    Filter("B", "100 * n_distinct < 50 * n_words"),
    Filter("C", "100 * n_upper > 2 * n_chars"),
    Filter("D", "n_marks > 0"),
    Filter("E", "is_copy"),
)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, digest and the measures of every document but is_copy."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_TRIM))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    first = spread(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("t"), words.alias("w"))
    measures = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.length("t").cast("long").alias("n_chars"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^#$%&*|]+", "")).cast("long").alias("n_marks"),
        F.unhex(F.sha2("t", 256)).alias("digest"),
    )
    # A generator of one row keeps each measure computed once, whatever reads it.
    return first.select("id", "part", F.inline(F.array(measures)))


def _mask(filters: Sequence[Filter]) -> Column:
    bits = (F.when(F.expr(f.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters) if "is_copy" not in f.fails)
    return sum(bits, F.lit(0)).cast("int")


def cells(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part and mask of failures: n documents, good ones (quality 1) and toxic ones."""
    copy_bits = sum(1 << k for k, f in enumerate(filters) if "is_copy" in f.fails)
    if any("is_copy" in f.fails and f.fails != "is_copy" for f in filters):
        raise ValueError("is_copy stands alone in a filter's condition")
    rows = measured(docs, id_col, text_col, part_col).select("id", "part", "digest", _mask(filters).alias("mask"))
    rows = written(rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "masks")
    known = rows.where("id is not null")
    firsts = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = known.join(firsts, ["digest", "id"], "left").withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(copy_bits))))
    said = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic")]
    labelled = marked.join(said, "id", "left").select("part", "mask", "n", "is_good", "is_toxic")
    nameless = rows.where("id is null").select("part", "mask", "n", F.lit(None).cast("int").alias("is_good"), F.lit(None).cast("int").alias("is_toxic"))
    out = written(labelled.unionByName(nameless).groupBy("part", "mask").agg(*sums), "cells")
    dropped(rows)
    return out


def audit(cell_rows: DataFrame, letters: str) -> DataFrame:
    """Per part, order of the filters and step the counts of that step.

    cell_rows: part, mask, n, good, toxic, with bit k for the k-th letter. kept
    counts what is left after the step; removed, good_lost and toxic_lost what the
    step takes; redundant what it would take but for earlier steps; unique_fails
    what fails this filter only; shapley the filter's removed over all orders.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    # All steps of an order lie together, so the window and the sums below need no further shuffle.
    by_order = cell_rows.select("*", F.explode(orders).alias("filter_order")).repartition("part", "filter_order")
    steps = by_order.select("*", F.posexplode(F.split("filter_order", "")).alias("k", "letter")).withColumn("step", F.col("k") + 1)
    bit = F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)")
    cell = steps.withColumn("bit", bit).withColumn("own", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    fails, gone = F.col("own") != 0, F.col("earlier") != 0

    def total(what: Column, value: str = "n") -> Column:
        return F.sum(F.when(what, F.col(value)).otherwise(0)).cast("long")

    counts = cell.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``audit`` of the filters over whole documents."""
    return audit(cells(docs, labels, filters, id_col, text_col, part_col), "".join(f.letter for f in filters))
