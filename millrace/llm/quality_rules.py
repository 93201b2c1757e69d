"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements
and one long whose bit k says that rule k failed. A policy is a mask of rules
that must hold, so versioned policies and ablations are bitwise operations on
the ledger; the texts are never read again.

Defined results: a null or empty text has no words, all measures 0, and fails
min_words. Repeated rows each get their own row. Of the input only the id and
text columns are read, so other columns may have any name. An empty table gives
an empty ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spread import spread

SPACE = r"[\x20\x09-\x0D]"
_TRIM = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measures holds."""

    name: str
    fails: str  # SQL over the measures


#: Bit k belongs to rule k. Only ever append, so that old ledgers keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("min_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
#: Versioned policies: the names of the rules that a document must not fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("min_words", "repeated_words"),
    "v1": tuple(r.name for r in RULES),
}


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the named rules."""
    bit = {r.name: 1 << k for k, r in enumerate(rules)}
    return sum(bit[n] for n in names)


def _let(value: Column, body) -> Column:
    """body applied to value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    The windows are sorted with their positions, so equal windows are
    neighbours: n log n for a text of n words, whatever it repeats.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]).eqNullSafe(True) | (x["w"] == F.get(s, k + 1)["w"]).eqNullSafe(True))
        return _let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    # Only texts in which some window's hash comes twice need the sort.
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    none = (F.size(words) < 4) | (F.size(F.array_distinct(hashes)) == F.size(words) - 2)
    return F.when(none, F.lit(0).cast("long")).otherwise(_let(F.sort_array(windows), repeated))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The measures of every document; keep: further input columns to carry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_TRIM))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_TRIM)) != "")
    first = spread(docs).select(F.struct(F.col(id_col), *[F.col(c) for c in keep]).alias("_row"), text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    measures = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    # A generator of one row: filters on measures stay above it, so that each measure is computed once.
    return first.select("_row", F.inline(F.array(measures))).select("_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, measures and the long ``failed`` of failure bits."""
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0))
    return measured(docs, id_col, text_col, keep).withColumn("failed", bits.cast("long"))


def passes(policy: Sequence[str], rules: Sequence[Rule] = RULES, failed: str = "failed") -> Column:
    """Whether the ledger's row holds under the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask_of(policy, rules))) == 0


def ablation(ledger_df: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept without it.

    The rows are first summed by failure mask (at most 2 ** rules groups, merged
    before the shuffle); everything else works on those few sums.
    """
    mask = mask_of(policy, rules)
    by_mask = ledger_df.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    bits = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if r.name in policy])
    each = by_mask.select("m", "n", F.explode(bits).alias("r")).select("m", "n", "r.rule", "r.bit")
    left = F.col("m").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(left == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep_good(docs: DataFrame, policy: Sequence[str] = POLICIES["v1"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that hold under the policy, with all their columns."""
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_in"), docs[f"`{id_col}`"].alias("_id"), docs[f"`{text_col}`"].alias("_txt"))
    return ledger(row, "_id", "_txt", keep=["_in"]).where(passes(policy)).select("_in.*")
