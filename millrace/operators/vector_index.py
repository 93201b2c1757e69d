"""A stored vector index: lists by coarse centre, searched as far as a bound says they matter.

Centres are fitted on a bounded sample; every vector is filed under its nearest
one with its distance to it. Files of some FILE rows are ranges of list and
distance, so that a reader skips those without its lists, and a list of any length
lies over many. By the triangle inequality
a list has nothing nearer to a query than the query's distance to the centre less
the list's radius, and a vector nothing nearer than the difference of the two
distances. A search reads the lists nearest to each query first; from the k-th
score found follow the lists that may still matter, and within them the range of
distances. Its result is that of an exact scan, whatever the centres are.

A task works through its files list by list: blocks of a list's vectors are
multiplied by the queries that want them, and it sends out the k best of each.
Which queries want a list is told in the task, from queries and centres; there is
no table of pairs of queries and lists, and none of queries and vectors.

A filter holds inside the lists: the k-th score is of rows that pass it.
Vectors that are null, zero or not finite have no direction and lie in a list of
their own; they come last, with a null score, as in an exact scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from millrace.functions.folders import kept
from millrace.functions.spread import spread
from millrace.operators import retrieve

#: The list of vectors without a direction.
NOWHERE = -1
#: Scores are rounded to six places; distances and bounds get this much slack.
SLACK = 1e-5
#: Rows of a file, about.
FILE = 5000


def _unit(v: Column) -> Column:
    """v at length 1, in double precision; null where it has no direction."""
    wide = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    sound = (F.size(wide) > 0) & (length > 0) & (length < float("inf")) & ~F.isnan(length)
    return F.when(sound, F.transform(wide, lambda x: x / length))


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Of array<double>: a row for each, NaN where one is null or of another size."""
    out = np.full((len(vectors), size), np.nan)
    at, x = retrieve._by_length(vectors).get(size, ([], None))
    if len(at):
        out[at] = x
    return out


def _apart(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of every row of u from every centre; NaN for rows of NaN."""
    square = (u * u).sum(1)[:, None] - 2 * (u @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


def write(vectors: DataFrame, path: str, list_rows: int = 1000, most_lists: int = 1024, sample_rows: int = 50_000, seed: int = 3) -> None:
    """Files vectors (key, v, and columns for filters) under ``path``.

    All vectors with a direction have the same number of components. list_rows is
    the mean length of a list, up to most_lists lists; sample_rows bounds what the
    centres are fitted on. None of them changes what a search finds.
    """
    rows = kept(spread(vectors).withColumn("_u", _unit(F.col("v"))), "units")
    total = rows.where("_u is not null").count()
    lists = max(1, min(most_lists, total // list_rows))
    sample = rows.where("_u is not null").select("_u").where(F.rand(seed) < min(1.0, 1.5 * sample_rows / max(1, total))).limit(sample_rows)
    # A limit leaves one partition.
    sample = sample.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    if total:
        centres = KMeans(k=lists, seed=seed, maxIter=8, featuresCol="f", initMode="random", solver="row").fit(sample.select(array_to_vector("_u").alias("f"))).clusterCenters() if lists > 1 else []
    if not total or not len(centres):
        centres = [r["_u"] for r in sample.limit(1).collect()] or [[0.0]]
    centres = np.asarray(centres, float)  # at most most_lists
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<radius: double, list: int>")
    def near(u: pa.Array) -> pa.Array:
        radius, found = np.zeros(len(u)), np.zeros(len(u), np.int32)
        for a in range(0, len(u), retrieve.QUERIES):
            far = _apart(_matrix(u.slice(a, retrieve.QUERIES), shared.value.shape[1]), shared.value)
            here = slice(a, a + len(far))
            found[here] = np.where(np.isnan(far), np.inf, far).argmin(1)
            radius[here] = far[np.arange(len(far)), found[here]]
        nowhere = np.isnan(radius)
        return pa.StructArray.from_arrays([pa.array(radius, mask=nowhere), pa.array(np.where(nowhere, NOWHERE, found).astype(np.int32))], names=["radius", "list"])

    filed = rows.withColumn("_n", near("_u")).select(*vectors.columns, "_n.radius", "_n.list")
    filed.repartitionByRange(max(1, -(-total // FILE)), "list", "radius", "key").sortWithinPartitions("list", "radius").write.mode("overwrite").parquet(f"{path}/rows")
    found = rows.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "list int, centre array<double>")
    sizes = _rows(rows.sparkSession, path).groupBy("list").agg(F.max("radius").alias("most"), F.count("*").alias("n"))
    sizes.join(F.broadcast(found), "list", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


class _Lists:
    """Centres, radii and numbers of rows that may be found, of at most some thousand lists."""

    def __init__(self, rows: list, allowed: dict[int, int]):
        own = sorted((r for r in rows if r["list"] != NOWHERE), key=lambda r: r["list"])
        self.nowhere = len(own) < len(rows)
        self.names = np.array([r["list"] for r in own], np.int64)
        self.centres = np.array([r["centre"] for r in own], float) if own else np.zeros((0, 1))
        self.most, self.n = np.array([r["most"] for r in own], float), np.array([allowed.get(r["list"], 0) for r in own], np.int64)

    def ahead(self, u: np.ndarray, first: int, k: int) -> np.ndarray:
        """Which lists each query reads first: the nearest ones, as many as hold k rows, ``first`` at least; none without a direction."""
        far = _apart(u, self.centres)
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        wanted = np.zeros(far.shape, bool)
        np.put_along_axis(wanted, order, (before < k) | (np.arange(far.shape[1]) < first)[None, :], axis=1)
        return wanted & ~np.isnan(far)

    def behind(self, u: np.ndarray, least: np.ndarray, at: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which lists may hold something as good as the queries' k-th scores (NaN: there is none), and the ends of the range of distances."""
        far, least = _apart(u, self.centres[at]), least[:, None]
        nearest = np.maximum(far - self.most[at], 0.0)
        may = np.isnan(least) | (1 - nearest * nearest / 2 + SLACK >= least)
        reach = np.where(np.isnan(least) | np.isnan(far), np.inf, np.sqrt(np.maximum(2 - 2 * least, 0.0)) + SLACK**0.5)
        return may, np.nan_to_num(far) - reach, np.nan_to_num(far) + reach


class Search:
    """Queries (query_id, q) against a stored index; allowed filters rows before they are ranked.

    Queries are a batch of any size with distinct ids, broadcast in groups of bounded size.
    """

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int, allowed: Column | None = None, first: int = 2):
        if k < 1:
            raise ValueError("k must be at least 1")
        self.k, self.rows = k, _rows(spark, path)
        held = spark.read.parquet(f"{path}/lists").collect()
        if allowed is not None:
            self.rows = self.rows.where(allowed)
            counts = {r["list"]: r["count"] for r in self.rows.groupBy("list").count().collect()}
        else:
            counts = {r["list"]: r["n"] for r in held}
        self.rows = self.rows.select("key", F.col("v").cast("array<double>").alias("v"), "radius", "list")
        self.lists = _Lists(held, counts)
        asked = kept(queries.select("query_id", F.col("q").cast("array<double>").alias("q"), _unit(F.col("q")).alias("u")), "asked")
        self.size = asked.count()
        ahead = kept(self._listed(asked.withColumn("least", F.lit(None).cast("double")), lambda lists, u, _: lists.ahead(u, first, k), "done"), "near-lists")
        self.near = kept(self._scored(ahead, "done"), "near-scores")
        least = retrieve.top_k(self.near.where("score is not null"), k, [F.col("score").desc(), F.col("key").asc()]).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        self.asked = kept(self._listed(ahead.drop("least").join(least, "query_id", "left"), lambda lists, u, least: lists.behind(u, least)[0], "rest"), "far-lists")

    def _listed(self, asked: DataFrame, which: Callable, name: str) -> DataFrame:
        """asked (with u and least) and, under ``name``, the lists that ``which`` tells of each query and that it hasn't read."""
        lists, schema = self.lists, StructType([*asked.schema.fields, StructField(name, ArrayType(IntegerType()))])

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, retrieve.QUERIES):
                    b = whole.slice(a, retrieve.QUERIES)
                    least = b.column("least").to_numpy(zero_copy_only=False).astype(float)
                    wanted = which(lists, _matrix(b.column("u"), lists.centres.shape[1]), least)
                    nowhere = np.full(len(wanted), lists.nowhere and name == "rest") & np.isnan(least)
                    if "done" in b.schema.names:
                        done = b.column("done")
                        wanted[np.repeat(np.arange(len(wanted)), pc.list_value_length(done)), np.searchsorted(lists.names, done.flatten())] = False
                    wanted, names = np.hstack([wanted, nowhere[:, None]]), np.append(lists.names, NOWHERE)
                    flat = pa.array(names[np.nonzero(wanted)[1]].astype(np.int32))
                    ends = pa.array(np.append(0, np.cumsum(wanted.sum(1))).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, flat)], names=[*b.schema.names, name])

        return asked.mapInArrow(told, schema)

    def _scored(self, asked: DataFrame, wave: str) -> DataFrame:
        """(query_id, key, score) of the k best rows, of each task and query, in the lists under ``wave``."""
        lists, k = self.lists, self.k
        open_ = [r["list"] for r in asked.select(F.explode(wave).alias("list")).distinct().collect()]  # at most all lists
        rows, found = self.rows.where(F.col("list").isin(open_)), []
        schema = StructType([asked.schema["query_id"], self.rows.schema["key"], StructField("score", DoubleType())])
        id_type = to_arrow_type(asked.schema["query_id"].dataType)
        for part in retrieve._in_groups(asked.select("query_id", "q", "u", "least", "done"), self.size, retrieve.GROUP_QUERIES):
            held, size = part.toArrow(), lists.centres.shape[1]
            column = lambda name, held=held: retrieve._column(held, name)
            done = column("done")
            by, of = done.flatten().to_numpy(), np.repeat(np.arange(len(done)), pc.list_value_length(done))
            order = np.argsort(by, kind="stable")
            shared = asked.sparkSession.sparkContext.broadcast(
                (column("query_id").cast(id_type), _matrix(column("q"), size), _matrix(column("u"), size), column("least").to_numpy(zero_copy_only=False).astype(float), by[order], of[order])
            )

            def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q, u, least, by, of = shared.value
                every = np.arange(len(ids))

                def wanting(name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    """The queries that read a list in this wave, and their ranges of distances."""
                    if name == NOWHERE:
                        own = np.flatnonzero(np.isnan(least))
                        return own, np.full(len(own), -np.inf), np.full(len(own), np.inf)
                    done = of[np.searchsorted(by, name) : np.searchsorted(by, name, side="right")]
                    if wave == "done":
                        return done, np.full(len(done), -np.inf), np.full(len(done), np.inf)
                    at = int(np.searchsorted(lists.names, name))
                    may, low, high = (c[:, 0] for c in lists.behind(u, least, slice(at, at + 1)))
                    own = np.setdiff1d(every[may], done)
                    return own, low[own], high[own]

                last, asking = None, ()
                for b in batches:
                    names, radius = b.column("list").to_numpy(), b.column("radius").to_numpy(zero_copy_only=False)
                    x = _matrix(b.column("v"), size)
                    # Keys of any type rank by their order in the batch, null first.
                    order = pc.sort_indices(b.column("key"), null_placement="at_start").to_numpy().astype(np.int64)
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    top = retrieve.Best(len(ids), k)
                    top.least = np.where(np.isnan(least), -np.inf, least)
                    cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)] if len(names) else []
                    for start, end in zip(cuts, cuts[1:]):
                        if names[start] != last:
                            last, asking = names[start], wanting(int(names[start]))
                        for a in range(start, end, retrieve.ROWS):
                            z = min(a + retrieve.ROWS, end)
                            own = asking[0]
                            if last != NOWHERE:
                                own = own[(asking[1] <= radius[a:z].max()) & (asking[2] >= radius[a:z].min())]
                            for c in range(0, len(own), retrieve.QUERIES):
                                of_block = own[c : c + retrieve.QUERIES]
                                top.add(retrieve.cosines(x[a:z], q[of_block]), rank[a:z], of_block)
                    at, key, s = top.result()
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), b.column("key").take(pa.array(order[key])), pa.array(s, mask=np.isneginf(s))], names=["query_id", "key", "score"])

            found.append(rows.mapInArrow(best, schema))
        return reduce(DataFrame.unionByName, found)

    def hits(self) -> DataFrame:
        """(query_id, key, score, rank) of the k nearest, equal scores by key."""
        return retrieve.top_k(self.near.unionByName(self._scored(self.asked, "rest")), self.k, [F.col("score").desc(), F.col("key").asc()])

    def report(self) -> DataFrame:
        """Per query the lists there are and the lists read."""
        return self.asked.select("query_id", F.lit(len(self.lists.names) + int(self.lists.nowhere)).cast("long").alias("lists"), (F.size("done") + F.size("rest")).cast("long").alias("read"))
