"""Raw tables (rows of nullable cells) as array<array<string>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip


def _cells(row: Column) -> Column:
    return F.transform(row, lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))


def looks_like_table(table: Column) -> Column:
    """At least two rows, two columns and two rows with two filled cells; cells of at most 300 and 80 characters on average."""
    filled = F.transform(table, lambda r: F.filter(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != ""))
    sizes = F.transform(F.flatten(filled), lambda c: F.length(c))
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    return F.coalesce(
        (F.size(table) >= 2)
        & (F.array_max(F.transform(table, lambda r: F.size(r))) >= 2)
        & (F.size(F.filter(filled, lambda r: F.size(r) >= 2)) >= 2)
        & ~F.exists(sizes, lambda n: n > 300)
        & (total <= 80 * F.size(sizes)),
        F.lit(False),
    )


def to_markdown(table: Column) -> Column:
    """A Markdown table; ragged rows are filled up, and an empty first row gives an empty text."""
    width = F.array_max(F.transform(table, lambda r: F.size(r)))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def padded(row: Column) -> Column:
        return line(F.concat(_cells(row), F.array_repeat(F.lit(""), (width - F.size(row)).cast("int"))))

    rows = F.transform(table, padded)
    rule = line(F.array_repeat(F.lit("---"), width.cast("int")))
    body = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")
    return F.when((F.size(table) == 0) | (F.size(table[0]) == 0), F.lit("")).otherwise(body)
