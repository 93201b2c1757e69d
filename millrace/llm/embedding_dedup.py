"""Embedding near-duplicates: product quantisation with exact bounds, exact cosine rerank.

Vectors are brought to unit length and equal ones become one class, which has a
number. Coarse centres and codebooks of their residuals are trained on a bounded
sample; every class is filed in the list of its nearest centre, with the codes
of its residual and the length that the codes miss. Long lists are cut into
blocks. A block probes every list whose cell comes within reach of one of its
vectors, so no link can lie outside the probes; blocks whose balls are too far
apart are left out too. In a pair of blocks, table look-ups give the product of
each vector with each coded one; the missed length bounds the error, and what
may still link is reranked by exact products in double precision. Where balls
lie so near that all pairs must link, they are counted without being compared.

Blocks travel packed, in spans of lists; a task takes two spans at most, so
that neither rows nor tasks grow with a list. Tasks give counts per vector and
a spanning forest of their links, never the pairs.

Defined results: a null, empty or zero vector, or one with a null or non-finite
component, links with nothing and is its own component, and so is one without an
id; vectors of different lengths never link; ids only name rows: repeated ids
each get a row, and are other vectors to each other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, join_unique, more_fields, written
from millrace.llm.components import Forest, components

#: Members of one block of a list.
BLOCK = 1024
#: Numbers (vectors times dimensions) in one span of blocks; a task holds two spans.
SPAN = 1 << 20


@dataclass
class PqIndex:
    """centres: (lists, d); books: (subspaces, codewords, width)."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row its list, its codes, and its quantisation error (length of what the codes miss)."""
        of = nearest(x, self.centres)
        rest = _padded(x - self.centres[of], self.books)
        codes, error = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, m * self.width : (m + 1) * self.width]
            codes[:, m] = nearest(part, book)
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        return of, codes, np.sqrt(error)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query's parts with each codeword: (queries, subspaces, codewords)."""
        q = _padded(q, self.books)
        return np.stack([q[:, m * self.width : (m + 1) * self.width] @ book.T for m, book in enumerate(self.books)], 1)

    def reached(self, q: np.ndarray, own: int, reach: float) -> np.ndarray:
        """The lists whose cells come within ``reach`` of any of the vectors filed in list ``own``; all of them."""
        d = _squares(q, self.centres)
        apart = np.sqrt(((self.centres - self.centres[own]) ** 2).sum(1))
        plane = ((d - d[:, own : own + 1]) / np.maximum(2 * apart, 1e-12)).min(0)
        return np.flatnonzero((plane <= reach + 1e-6) | (apart < 1e-6))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]


def _padded(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    more = books.shape[0] * books.shape[2] - x.shape[1]
    return np.pad(x, ((0, 0), (0, more))) if more else x


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[k : k + 8192] @ centres.T - half).argmax(1) for k in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        total, n = np.zeros_like(centres), np.bincount(of, minlength=k)
        np.add.at(total, of, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def train(sample: np.ndarray, lists: int, subspaces: int = 8, codewords: int = 256, seed: int = 5) -> PqIndex:
    d = sample.shape[1]
    centres = kmeans(sample, lists, 8, seed)
    width = -(-d // min(subspaces, d))
    parts = -(-d // width)
    rest = sample - centres[nearest(sample, centres)]
    rest = np.pad(rest, ((0, 0), (0, parts * width - d)))
    books = [kmeans(rest[:, m * width : (m + 1) * width], codewords, 6, seed + m + 1) for m in range(parts)]
    return PqIndex(centres, np.stack(books))


def candidates(index: PqIndex, at: int, codes: np.ndarray, error: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Which (query, member) pairs of a block of list ``at`` may link: look-ups plus the members' missed lengths reach the threshold."""
    table = index.tables(q).astype(np.float32)
    near = np.repeat((q @ index.centres[at]).astype(np.float32)[:, None], len(codes), 1)
    for m in range(table.shape[1]):
        near += np.take(table[:, m], codes[:, m], axis=1)
    # The slack is far above what single precision loses in so few sums of products of unit vectors.
    return near >= (threshold - 1e-4 - error).astype(np.float32)[None]


def _units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (of unit length; null where it can't link) and k, a digest of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            start = np.cumsum(size) - size
            unit: list[np.ndarray | None] = [None] * len(size)
            for d in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == d)
                x = flat[start[own][:, None] + np.arange(d)]
                big = np.abs(x).max(1)
                able = np.isfinite(x).all(1) & (big > 0)
                # The largest component is brought to 1 first, so that squares neither vanish nor overflow.
                x = x[able] / big[able, None]
                x = x / np.sqrt((x * x).sum(1))[:, None] + 0.0
                for k, row in zip(own[able].tolist(), x, strict=True):
                    unit[k] = row
            key = [None if u is None or i is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u, i in zip(unit, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(unit, pa.list_(pa.float64())), pa.array(key, pa.binary())], names=["id", "v", "k"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, v array<double>, k binary")


def link_embeddings(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = 20_000, list_rows: int = 400, most_lists: int = 4096) -> DataFrame:
    """id, n_links, component_id and kept for every row.

    sample_rows bounds what the index is fitted on; list_rows is the mean length
    of a list, up to most_lists lists. None of them changes the result: every
    list in which a vector could have links is probed.
    """
    spark = vectors.sparkSession
    rows = written(_units(vectors, id_col, vec_col), "vectors")
    classes = rows.where("k is not null").groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    dims = [r["d"] for r in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    linked, used = None, []
    for d in dims:
        own = classes.where(F.size("v") == d)
        part = _links(spark, own, total, threshold, sample_rows, min(most_lists, max(1, total // list_rows)), used)
        linked = part if linked is None else linked.union(part)
    if linked is None:
        linked = spark.createDataFrame([], "cid long, n_other long, parent long")
    linked = written(linked, "pairs")
    counts = linked.where("n_other > 0").groupBy("cid").agg(F.sum("n_other").alias("n_other"))
    roots = components(linked.where("parent is not null"), "cid", "parent")
    by_class = classes.select("k", "cid", "least", "n").join(counts, "cid", "left").join(roots, F.col("cid") == F.col("child"), "left")
    by_class = written(by_class.select("k", "n", "least", (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"), F.coalesce("parent", "cid").alias("root")), "rooted")
    tops = written(by_class.groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("weight")), "tops")
    by_key = written(join_unique(by_class.drop("least"), tops, "root", "weight").select("k", "n", "n_links", "top"), "by-key")
    dropped(classes, linked, by_class, tops, roots, *used)
    narrow = rows.select("id", "k")
    unable = narrow.where("k is null").select("k", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("top"))
    out = join_unique(narrow.where("k is not null"), by_key, "k", "n").unionByName(unable)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("top").alias("component_id"), F.coalesce(F.col("id") == F.col("top"), F.lit(False)).alias("kept"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _links(spark, classes: DataFrame, total: int, threshold: float, sample_rows: int, lists: int, used: list[DataFrame]) -> DataFrame:
    """(cid, n_other, parent): link counts per class, weighted by class sizes, and forest links. used gets the tables that the result reads."""
    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    sample = classes.select("v").where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(sample_rows)
    x = np.array([r["v"] for r in sample.collect()], float)
    if len(x) == 0:
        x = np.array([r["v"] for r in classes.select("v").limit(sample_rows).collect()], float)
    index = train(x[np.lexsort(x.T[::-1])], lists)
    shared = spark.sparkContext.broadcast(index)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, codes, error = shared.value.encode(_matrix(b.column("v"))) if b.num_rows else (np.zeros(0), np.zeros((0, 1), np.uint8), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("n"), b.column("v"), pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["cid", "n", "v", "list", "codes", "error"])

    held = classes.select("cid", "n", "v")
    filed = written(held.mapInArrow(assign, more_fields(held.schema, "list int, codes binary, error double")), "filed")
    # Lists lie in the order of their centres' main direction, cut into blocks and spans; at most most_lists of them.
    size = np.zeros(len(index.centres), np.int64)
    for r in filed.groupBy("list").count().collect():
        size[r["list"]] = r["count"]
    middle = index.centres - index.centres.mean(0)
    order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
    start = np.zeros(len(size), np.int64)
    start[order] = np.cumsum(size[order]) - size[order]
    blocks = np.maximum(1, -(-size // BLOCK))
    first, per, span = np.cumsum(blocks) - blocks, -(-size // blocks), max(BLOCK, SPAN // index.centres.shape[1])
    layout = spark.sparkContext.broadcast((start, blocks, first, per))
    lists = F.broadcast(spark.createDataFrame([(k, int(n), int(f)) for k, (n, f) in enumerate(zip(blocks, first, strict=True))], "list int, blocks int, first long"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        start, blocks, first, per = layout.value
        at, x = t["list"][0].as_py(), _matrix(t["v"])
        lists = shared.value.reached(x, at, reach)
        lists = lists[size[lists] > 0]
        low, high = start[lists] // span, (start[lists] + (blocks[lists] - 1) * per[lists]) // span
        own = int(start[at] + (key[0].as_py() - first[at]) * per[at]) // span
        row = {"bid": key[0].as_py(), "list": at, "span": own, "reached": lists.tolist(), "spans": sorted({s for a, b in zip(low.tolist(), high.tolist(), strict=True) for s in range(a, b + 1)})}
        row |= {"ids": t["cid"].to_numpy().astype(np.int64).tobytes(), "n": t["n"].to_numpy().astype(np.int64).tobytes(), "x": np.ascontiguousarray(x).tobytes(), "codes": b"".join(t["codes"].to_pylist()), "error": t["error"].to_numpy().tobytes()}
        kinds = {"bid": pa.int64(), "list": pa.int32(), "span": pa.int64(), "reached": pa.list_(pa.int32()), "spans": pa.list_(pa.int64())}
        return pa.Table.from_pylist([row], schema=pa.schema([(name, kinds.get(name, pa.binary())) for name in row]))

    blocked = filed.join(lists, "list").select((F.col("first") + F.pmod(F.xxhash64("cid"), F.col("blocks"))).alias("bid"), "list", "cid", "n", "v", "codes", "error")
    packed = written(blocked.groupBy("bid").applyInArrow(pack, "bid long, list int, span long, reached array<int>, spans array<long>, ids binary, n binary, x binary, codes binary, error binary"), "packed")
    used += [filed, packed]
    sent = packed.select("*", F.explode("spans").alias("other")).drop("spans")
    sent = sent.withColumns({"low": F.least("span", "other"), "high": F.greatest("span", "other")}).drop("other")

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        rows, of = [], 0
        for r in sorted(t.to_pylist(), key=lambda r: r["bid"]):
            ids = np.frombuffer(r["ids"], np.int64)
            x = np.frombuffer(r["x"], float).reshape(len(ids), -1)
            centre, codes = x.mean(0), np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
            rows.append({"codes": codes, "error": np.frombuffer(r["error"]), "bid": r["bid"], "list": r["list"], "span": r["span"], "reached": set(r["reached"]), "ids": ids, "n": np.frombuffer(r["n"], np.int64), "x": x, "centre": centre, "radius": np.sqrt(((x - centre) ** 2).sum(1).max()), "at": of})
            of += len(ids)
        found, forest = np.zeros(of, np.int64), Forest()
        for a in rows:
            for b in rows:
                if a["span"] != low or b["span"] != high or (low == high and a["bid"] > b["bid"]) or b["list"] not in a["reached"] or a["list"] not in b["reached"]:
                    continue
                apart, round_ = np.sqrt(((a["centre"] - b["centre"]) ** 2).sum()), a["radius"] + b["radius"]
                if apart - round_ <= reach + 1e-6:
                    _count(shared.value, a, b, None if apart + round_ < reach - 1e-6 else threshold, found, forest)
        ids = np.concatenate([r["ids"] for r in rows])
        hit = found > 0
        links = np.array(forest.links(), np.int64).reshape(-1, 2)
        return pa.table(
            {
                "cid": pa.array(np.concatenate([ids[hit], ids[links[:, 0]]])),
                "n_other": pa.array(np.concatenate([found[hit], np.zeros(len(links), np.int64)])),
                "parent": pa.array([None] * int(hit.sum()) + ids[links[:, 1]].tolist(), pa.int64()),
            }
        )

    return sent.groupBy("low", "high").applyInArrow(meet, "cid long, n_other long, parent long")


def _count(index: PqIndex, a: dict, b: dict, threshold: float | None, found: np.ndarray, forest: Forest) -> None:
    """Adds the links between two blocks (or in one) to counts and forest; without a threshold, all pairs link."""
    same = a is b
    mine, other = slice(a["at"], a["at"] + len(a["ids"])), slice(b["at"], b["at"] + len(b["ids"]))
    if threshold is None:
        found[mine] += b["n"].sum() - (a["n"] if same else 0)
        if not same:
            found[other] += a["n"].sum()
        for k in [*range(mine.start, mine.stop), *range(other.start, other.stop)] if not same or len(a["ids"]) > 1 else ():
            forest.join(a["at"], k)
        return
    hit = candidates(index, b["list"], b["codes"], b["error"], a["x"], threshold)
    # Rerank: products of the rows and columns that hold a candidate.
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    cosine = a["x"][rows] @ b["x"][columns].T
    own = hit[np.ix_(rows, columns)] & (cosine >= threshold)
    # At the threshold itself the plain sum decides, as a product's rounding hangs on its shape.
    i, j = np.nonzero(np.abs(cosine - threshold) <= 1e-9)
    own[i, j] = (a["x"][rows[i]] * b["x"][columns[j]]).sum(1) >= threshold
    hit[np.ix_(rows, columns)] = own
    if same:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    if not len(i):
        return
    found[mine] += np.bincount(i, b["n"][j], len(a["ids"])).astype(np.int64)
    if not same:
        found[other] += np.bincount(j, a["n"][i], len(b["ids"])).astype(np.int64)
    # One link of each row and each column first; of the rest, each pair of trees once.
    for first in (np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]):
        for p, q in zip((i[first] + mine.start).tolist(), (j[first] + other.start).tolist(), strict=True):
            forest.join(p, q)
    top_a, top_b = np.zeros(len(a["ids"]), np.int64), np.zeros(len(b["ids"]), np.int64)
    top_a[np.unique(i)] = [forest.root(k + mine.start) for k in np.unique(i).tolist()]
    top_b[np.unique(j)] = [forest.root(k + other.start) for k in np.unique(j).tolist()]
    apart = top_a[i] != top_b[j]
    for code in np.unique(top_a[i][apart] * len(found) + top_b[j][apart]).tolist():
        forest.join(*divmod(code, len(found)))
