"""Connected components of a link table, without gathering links anywhere.

The links are (child, parent) rows with parent < child. In each round every task
first reduces its own links to a spanning forest, in runs of bounded size; then
every child gets its smallest parent, its other parents are linked to that one,
and each parent stands for its own smallest parent. The rounds end when no parent
is a child; trees halve in depth each round at least. Every round is written to
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, join_unique, written


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        return True

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A task's links come in runs, so that the forest held is bounded; runs overlap as they may.
    forest, n = Forest(), 0
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        n += b.num_rows
        if n > 500_000:
            yield _batch(forest.links())
            forest, n = Forest(), 0
    yield _batch(forest.links())


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["child", "parent"])


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(child, parent) for every linked member but the smallest, which is the parent.

    links: two long columns; either order, repeats and self-links allowed. The
    result is a written table, which ``dropped`` takes when it has been read.
    """
    edges = links.select(F.col(a).cast("long").alias("child"), F.col(b).cast("long").alias("parent")).where("child is not null and parent is not null")
    step = written(edges.mapInArrow(_contracted, "child long, parent long").distinct(), "links")
    for _ in range(most_rounds):
        # A child has one parent a task at most at first, and few later on; a parent may have very many children.
        own = Window.partitionBy("child")
        forests = step.select("child", "parent").mapInArrow(_contracted, "child long, parent long")
        held = forests.select("child", "parent", F.min("parent").over(own).alias("least"), F.max("parent").over(own).alias("most"))
        links_ = F.array(F.struct("child", F.col("least").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")))
        new = held.select(F.explode(F.when(F.col("parent") == F.col("least"), F.slice(links_, 1, 1)).otherwise(links_)).alias("l"), (F.col("least") != F.col("most")).alias("torn"))
        flat = written(new.groupBy("l.child", "l.parent").agg(F.max("torn").alias("torn")), "hooked")
        # Per parent its number of children and its own least parent.
        ends = F.array(F.struct(F.col("parent").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("up")), F.struct(F.col("child").alias("at"), F.lit(0).alias("n"), F.col("parent").alias("up")))
        up = flat.select(F.inline(ends)).groupBy(F.col("at").alias("parent")).agg(F.sum("n").alias("n"), F.min("up").alias("up")).where("n > 0")
        up = written(up, "tops")
        jumped = join_unique(flat, up, "parent", "n").select("child", F.coalesce("up", "parent").alias("parent"), (F.col("up").isNotNull() | F.col("torn")).alias("moved"))
        # Repeats are dropped as the next round hooks; in the last one nothing moves, so there are none.
        last, step = step, written(jumped, "jumped")
        settled = step.where("moved").isEmpty()
        dropped(last, flat, up)
        if settled:
            out = step.select("child", "parent")
            out._millrace_path = step._millrace_path
            return out
    raise RuntimeError("components did not settle")
