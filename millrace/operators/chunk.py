"""Article-aware chunking: boundaries, annex context, splitting, identifiers.

A document's blocks are cut at article headings, long segments are split by a
cascade of separators, and what remains is numbered. Splits need back-tracking,
so that step is an Arrow function; headings are found by expressions and array
functions on one text, the rest are windows over one document's rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import ARTICLE_PATTERNS, Chunking
from millrace.functions.text import WS, strip

# Fixed values.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", " ", "")
ANNEX_WORDS = ("ilova", "приложение", "annex")
LABEL_CHARS = 40
#: Texts that are split at a time.
ROWS = 64

#: Stands before a heading while a text is cut; and what follows such a mark of the text's own.
CUT, OWN = "\ufdd0", "\ufdd1"


def heading_re(patterns: Sequence[str] = ARTICLE_PATTERNS) -> re.Pattern:
    return re.compile("|".join(p if p.startswith("^") else f"^{p}" for p in patterns), re.MULTILINE | re.IGNORECASE)


def boundaries(text: str, heading: re.Pattern) -> list[tuple[int, str]]:
    """Offset and label of every heading: its line up to a full stop, dash or colon."""
    found = []
    for m in heading.finditer(text):
        line = text[m.start() : text.find("\n", m.start()) if "\n" in text[m.start() :] else len(text)]
        label = re.split(r"[.\-—:]", line.strip(), maxsplit=1)[0].strip()
        found.append((m.start(), label[:LABEL_CHARS]))
    return found


def segments(text: str, heading: re.Pattern) -> list[tuple[int, str | None, str]]:
    """(offset, label or None, stripped text) from heading to heading; blank ones are left out."""
    cuts = boundaries(text, heading)
    if not cuts:
        return [(0, None, text)]
    ends = [off for off, _ in cuts[1:]] + [len(text)]
    parts = [(0, None, text[: cuts[0][0]])] + [(off, label, text[off:end]) for (off, label), end in zip(cuts, ends, strict=True)]
    return [(off, label, body.strip()) for off, label, body in parts if body.strip()]


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    done, run, total = [], [], 0
    for piece in pieces:
        if run and total + len(piece) > size:
            done.append("".join(run).strip())
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(run.pop(0))
        run.append(piece)
        total += len(piece)
    done.append("".join(run).strip())
    return [d for d in done if d]


def recursive_split(text: str, size: int = 800, overlap: int = 120, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that occurs; the tail of one begins the next.

    A separator stays at the start of what follows it.
    """
    k = next(i for i, s in enumerate(separators) if not s or s in text)
    mark, finer = separators[k], separators[k + 1 :]
    if mark:
        first, *others = text.split(mark)
        parts = [p for p in [first, *(mark + o for o in others)] if p]
    else:
        parts = list(text)
    done, run = [], []
    for part in parts:
        if len(part) < size:
            run.append(part)
            continue
        done += _merged(run, size, overlap) if run else []
        run = []
        done += recursive_split(part, size, overlap, finer) if finer else [part]
    return done + (_merged(run, size, overlap) if run else [])


def _java(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{WS}]").replace(r"\d", r"\p{Nd}")


def _heading(patterns: Sequence[str]) -> str:
    """heading_re for Java; patterns in a row share one anchor, so that most places of a text are told by one look."""
    groups: list[list[str]] = []
    for p in patterns:
        # An alternative within a pattern may stand without the anchor.
        if "|" in p or not groups or "|" in groups[-1][0]:
            groups.append([])
        groups[-1].append(_java(p.removeprefix("^")))
    return "(?miud)" + "|".join(f"^{g[0]}" if "|" in g[0] else f"^(?:{'|'.join(g)})" for g in groups)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, in as many rounds as the array's size has binary digits."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(numbers))
    upto = F.aggregate(steps, numbers, lambda sums, d: F.transform(sums, lambda n, i: n + F.coalesce(F.get(sums, i - d), F.lit(0))))
    return F.zip_with(upto, numbers, lambda s, n: s - n)


def segment_column(content: Column, patterns: Sequence[str] = ARTICLE_PATTERNS) -> Column:
    """From heading to heading, what comes before the first in front: an array of off, whole, content; null for null.

    off counts code points, whole is the part with its white space, content is
    stripped and may be empty. A text without headings is one part as it is. Every
    heading gets a mark before it, and the text is cut at the marks. Of classes the
    patterns may use sets, ``\\s`` and ``\\d``, which are Unicode's.
    """
    marked = F.regexp_replace(F.replace(content, F.lit(CUT), F.lit(CUT + OWN)), _heading(patterns), CUT + "$0")
    parts = F.transform(F.split(marked, f"{CUT}(?!{OWN})"), lambda p: F.replace(p, F.lit(CUT + OWN), F.lit(CUT)))

    def placed(parts: Column) -> Column:
        def one(p: Column, off: Column) -> Column:
            return F.struct(off.alias("off"), p.alias("whole"), F.when(F.size(parts) == 1, p).otherwise(strip(p)).alias("content"))

        return F.zip_with(parts, _once(F.transform(parts, F.length), _before), one)

    return _once(parts, placed)


def label_column(whole: Column) -> Column:
    """The label of a part that begins with a heading: its first line up to a full stop, dash or colon."""
    line = strip(F.substring_index(whole, "\n", 1))
    return F.substring(strip(F.regexp_extract(line, r"\A[^.\-—:]*", 0)), 1, LABEL_CHARS)


def segment_rows(rows: DataFrame, doc: Sequence[str], content: str = "content", patterns: Sequence[str] = ARTICLE_PATTERNS) -> DataFrame:
    """A row for each segment of the texts, one a document, with off (in code points), label, content; blank ones are left out.

    A text is cut where it lies, so nothing is shuffled by doc, the documents' key.
    """
    kept = [c for c in rows.columns if c != content]
    cut = rows.select(*[f"`{c}`" for c in kept], F.posexplode(segment_column(F.col(content), patterns)).alias("_i", "_s"))
    label = F.when(F.col("_i") > 0, label_column(F.col("_s.whole")))
    return cut.select(*[f"`{c}`" for c in kept], F.col("_s.off").alias("off"), label.alias("label"), F.col("_s.content").alias("content")).where("content <> ''")


def split_column(content: Column, size: int, overlap: int) -> Column:
    """Texts of at most ``size`` characters as they are, longer ones in pieces."""

    @F.arrow_udf("array<string>")
    def run(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        # Python holds some texts of a batch at a time.
        done = [pa.array([t and recursive_split(t, size, overlap) for t in text.slice(a, ROWS).to_pylist()], kind) for a in range(0, len(text), ROWS)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    # A function's argument is computed for all rows, so short texts are kept from it here.
    return F.when(F.length(content) <= size, F.array(content)).otherwise(run(F.when(F.length(content) > size, content)))


def is_annex(label: Column) -> Column:
    return F.coalesce(F.lower(label).rlike("|".join(ANNEX_WORDS)), F.lit(False))


def with_annex(rows: DataFrame, doc: Sequence[str], order: Sequence[str], kind: str = "kind", label: str = "label") -> DataFrame:
    """rows with article_label: the label under the last annex heading before it in its document.

    Tables get the annex alone; text without a label keeps none.
    """
    context = F.last(F.when(is_annex(F.col(label)), F.col(label)), ignorenulls=True)
    upto = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_annex", context.over(upto))
    inside = F.col("_annex").isNotNull() & ~is_annex(F.col(label))
    return out.withColumn(
        "article_label",
        F.when(F.col(kind) == "table", F.col("_annex")).when(F.col(label).isNull(), F.lit(None)).when(inside, F.concat("_annex", F.lit(" / "), F.col(label))).otherwise(F.col(label)),
    ).drop("_annex")


def chunk_blocks(blocks: DataFrame, settings: Chunking | None = None) -> DataFrame:
    """Chunks of blocks(source_path, filename, file_hash, language_hint, block_idx, kind, content, page)."""
    settings = settings or Chunking()
    whole = F.array(F.struct(F.lit(0).alias("off"), F.col("content").alias("whole"), F.col("content")))
    cut = F.when(F.col("kind") == "table", whole).otherwise(segment_column(F.col("content"), settings.article_patterns))
    rows = blocks.select("*", F.posexplode(cut).alias("segment", "_s")).where("_s.content <> ''")
    label = F.when(F.col("segment") > 0, label_column(F.col("_s.whole")))
    rows = rows.withColumns({"label": label, "content": F.col("_s.content")}).drop("_s")
    rows = with_annex(rows, ["source_path", "file_hash"], ["block_idx", "segment"])
    pieces = F.when(F.col("kind") == "table", F.array("content")).otherwise(split_column(F.col("content"), settings.size, settings.overlap))
    rows = rows.select("*", F.posexplode(pieces).alias("piece", "_c")).withColumn("content", strip(F.col("_c"))).drop("_c", "label")
    return numbered(rows.where(F.length("content") >= settings.min_chars), ["block_idx", "segment", "piece"])


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Kept chunks with chunk_id and token_estimate; numbers count from 0 in each document."""
    number = F.row_number().over(Window.partitionBy("source_path", "file_hash").orderBy(*order)) - 1
    out = rows.withColumn("chunk_id", F.format_string("%s_%04d", F.substring("file_hash", 1, 8), number))
    estimate = F.greatest(F.lit(1), F.floor(F.length("content") / 4).cast("int"))
    return out.select("chunk_id", "content", "source_path", "filename", "file_hash", "page", "kind", "article_label", "language_hint", estimate.alias("token_estimate"))
