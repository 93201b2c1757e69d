"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

A document is the set of its word shingles, as 64-bit hashes. Its sketch fills T
coordinates in rounds: each round hashes every shingle into a bin with a value
that grows with the round, and the least value stays; from round T on, every
shingle goes to one bin in turn, so after 2 T rounds none is empty. Two sketches
agree in a coordinate with the sets' Jaccard similarity, concentrated as if the
coordinates were independent.

Documents with equal sets are one class, which has a number, a row to stand for
it and that row's text. Classes that share a band of the sketch are candidates.
A bucket's classes are first held against its smallest one only, which settles
large groups of copies in a number of comparisons that is linear in them. Then,
for buckets that still hold several components, the classes outside a bucket's
largest component are compared with all that are in other components than
theirs, in blocks of bounded size, by sketch and then on the full sets. Every
candidate pair is thereby either compared, or inside one component already. At
the threshold of 0.8, a pair misses all 32 bands of 5 with a chance of 3e-6, and
the sketch comparison lies 5.5 deviations below.

Defined results: words are runs of characters other than space and \\t to \\r,
with A-Z lower-cased; fewer words than a shingle has make the whole sequence one
shingle; a null text, or one without words, has an empty set, links with nothing
and is its own component. Ids are integers and only name rows: rows of one id
with different texts are different documents, and each is linked by its own
text; a null id takes part in no link. Repeated rows are one class, and each
gets its row. Empty tables give empty results; other columns are not read, and
may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.spread import spread
from millrace.llm.common import addressed, dropped, join_unique, mix64, settled, written
from millrace.llm.components import Forest, components
from millrace.llm.words import slices, words

T, BANDS, ROWS = 160, 32, 5
#: Members of a hub that are compared in one part at least, and classes of a bucket that meet at a time.
PART, BLOCK = 4096, 1024
#: Bytes of text of one block's members, and of texts whose sets are made together.
BLOCK_BYTES, SLICE = 16 << 20, 4 << 20

_SEEDS = mix64(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64((1 << 40) - 1)
_EMPTY = np.uint64(2**64 - 1)
_PRIME = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts in one array, and where each text's begin."""
    found, code, at = words(texts, lower=True)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))[code]
    n = np.diff(at)
    many = np.where(n >= size, n - size + 1, n > 0)
    ends = np.append(0, np.cumsum(many))
    first = np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1], many)
    long = np.repeat(np.minimum(n, size), many)
    out, acc = np.zeros(ends[-1], np.uint64), h
    for k in range(1, size + 1):
        own = np.flatnonzero(long == k)
        out[own] = mix64(acc[first[own]] + np.uint64(k))
        acc = mix64(acc[:-1] * _PRIME) + h[k:] if len(acc) else acc
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[a:z].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][many > 0]] = True
    return out[new], np.append(0, np.cumsum(new))[ends]


def sketches(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The T coordinates of each set: round number over 40 bits of hash; those of an empty set stay at the top."""
    out = np.full((len(at) - 1, T), _EMPTY)
    flat, of, r = out.reshape(-1), np.repeat(np.arange(len(at) - 1), np.diff(at)), 0
    live = np.flatnonzero(np.diff(at))
    while len(live) and r < 2 * T:
        # Further rounds don't change a full sketch, so few shingles take many rounds at once.
        many = min(1 + 65536 // len(s), T - r if r < T else 2 * T - r)
        h = mix64(s[None, :] ^ _SEEDS[r : r + many, None])
        rounds = np.arange(r, r + many, dtype=np.uint64)[:, None]
        bins = ((h >> np.uint64(40)) * np.uint64(T) >> np.uint64(24)).astype(np.int64) if r < T else (rounds - np.uint64(T)).astype(np.int64)
        np.minimum.at(flat, (of[None, :] * T + bins).ravel(), ((rounds << np.uint64(40)) | (h & _LOW)).ravel())
        r += many
        full = (out[live] != _EMPTY).all(1)
        if full.any():
            live = live[~full]
            more = np.zeros(len(out), bool)
            more[live] = True
            more = more[of]
            s, of = s[more], of[more]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """Per sketch one signed 64-bit hash for each band, the band's number included."""
    rows = sketch.reshape(-1, BANDS, ROWS)
    acc = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)), rows.shape[:2])
    for j in range(ROWS):
        acc = mix64(acc * _PRIME + rows[:, :, j])
    return acc.view(np.int64)


def least_agreement(threshold: float) -> int:
    """Equal coordinates below which two sketches are taken to be apart."""
    return int(np.floor(T * threshold - 5.5 * np.sqrt(T * threshold * (1 - threshold))))


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted distinct sets have a Jaccard similarity of at least threshold (in hundredths)."""
    if not len(x) or not len(y):
        return False
    percent = round(100 * threshold)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, address, n (set size), bytes, key (of the set; null where empty), bands, and low sketch bytes; docs: settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                s, at = shingle_sets(b.column("text"), size)
                sketch = sketches(s, at)
                low, data, n = (sketch & np.uint64(255)).astype(np.uint8).tobytes(), s.tobytes(), np.diff(at)
                key = [hashlib.blake2b(data[8 * a : 8 * z], digest_size=16).digest() if z > a else None for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                band = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands(sketch).ravel()))
                cols = [*[b.column(c) for c in ("id", "file", "row", "bytes")], pa.array(n, pa.int64()), pa.array(key, pa.binary()), band, pa.array([low[T * k : T * (k + 1)] for k in range(len(n))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "file", "row", "bytes", "n", "key", "bands", "low"])

    size_of = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = addressed(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), size_of.alias("bytes"))
    return spread(rows).mapInArrow(run, "id long, file long, row long, bytes long, n long, key binary, bands array<long>, low binary")


def _against_hubs(pairs: DataFrame, nodes: DataFrame, column: str, check: Callable[[pa.Array], Callable[[int, int], np.ndarray]], used: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) of a class and its hub that hold under ``check`` of their nodes' ``column``.

    A large hub's members come in parts, each behind a copy of the hub's row, so that
    they are spread over tasks; rows are streamed and no group is gathered.
    check takes an array of values and gives a function of two positions. used gets
    the tables that the result reads.
    """
    sizes = written(pairs.groupBy("b").agg(F.count("*").alias("n")), "hub-sizes")
    used.append(sizes)
    # Hubs with over a thousandth of all pairs, a thousand at most, are broadcast with their numbers of parts.
    least = max(PART, (sizes.agg(F.sum("n")).first()[0] or 0) // 1000)
    large = F.broadcast(sizes.where(F.col("n") > least).select("b", F.ceil(F.col("n") / least).cast("int").alias("parts")))
    of = nodes.select("cid", F.col(column).alias("v"))
    members = pairs.join(large, "b", "left").select("b", F.coalesce(F.pmod(F.xxhash64("a"), "parts").cast("int"), F.lit(0)).alias("part"), "a")
    members = members.join(of.withColumnRenamed("cid", "a"), "a").select("b", "part", "a", "v")
    heads = sizes.join(large, "b", "left").select("b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    heads = heads.join(of.withColumnRenamed("cid", "b"), "b")
    rows = members.unionByName(heads.select("b", "part", F.lit(None).cast("long").alias("a"), "v"))
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: pa.Array | None = None
        for whole in batches:
            for b in slices(whole, "v", SLICE):
                is_head = b.column("a").is_null().to_numpy(zero_copy_only=False)
                values = b.column("v") if head is None else pa.concat_arrays([head, b.column("v")])
                carried = int(head is not None)
                holds, good, at = check(values), np.zeros(b.num_rows, bool), 0
                for k in range(b.num_rows):
                    if is_head[k]:
                        at = k + carried
                    else:
                        good[k] = holds(k + carried, at)
                head = values.slice(at, 1)
                yield b.select(["a", "b"]).filter(pa.array(good))

    return rows.mapInArrow(run, "a long, b long")


def _sketch_check(least: int):
    def check(values: pa.Array):
        low = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, T)
        return lambda k, at: int((low[k] == low[at]).sum()) >= least

    return check


def _text_check(size: int, threshold: float):
    def check(values: pa.Array):
        s, at = shingle_sets(values, size)
        return lambda k, of: similar(s[at[k] : at[k + 1]], s[at[of] : at[of + 1]], threshold)

    return check


def _blocks(placed: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Members of buckets with several components, for blocks (bh, i, j) of outsiders and members.

    placed: (bh, cid, hub, bytes, comp), written. Those outside a bucket's largest
    component go to all its blocks of members (side 1), and every member goes to all
    its blocks of outsiders (side 0): where few stand outside, the rows are in
    proportion to the bucket.
    """
    parts = placed.groupBy("bh", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    mixed = parts.groupBy("bh").agg(F.max(F.struct("n", "b", "comp")).alias("main"), F.sum("n").alias("size"), F.sum("b").alias("total"), F.count("*").alias("comps"))

    def many(n, size):
        return F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES))).cast("int")

    out = [many(F.col("size") - F.col("main.n"), F.col("total") - F.col("main.b")).alias("outer"), many(F.col("size"), F.col("total")).alias("blocks")]
    mixed = written(mixed.where("comps > 1 and size > 2").select("bh", "size", F.col("main.comp").alias("main"), *out), "mixed")
    used.append(mixed)
    at = [F.pmod(F.xxhash64(F.col("cid"), F.lit(salt)), F.col(of)).cast("int") for salt, of in ((1, "outer"), (2, "blocks"))]
    rows = join_unique(placed, mixed, "bh", "size").select("bh", "cid", "hub", "comp", "outer", "blocks", at[0].alias("i"), at[1].alias("j"), (F.col("comp") != F.col("main")).alias("outside"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), F.lit(0).alias("side")))
    as_outsider = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.lit(1).alias("side")))
    each = F.when(F.col("outside"), F.concat(as_member, as_outsider)).otherwise(as_member)
    return rows.select("bh", "cid", "hub", "comp", "outside", F.explode(each).alias("at")).select("bh", "at.i", "at.j", "at.side", "cid", "hub", "comp", "outside")


def _across(bucketed: DataFrame, nodes: DataFrame, roots: DataFrame, size: int, threshold: float, used: list[DataFrame]) -> DataFrame:
    """Links (a, b) across components, of buckets that hold several.

    bucketed: (bh, cid, bytes, hub). A pair is compared in the first band it shares, and
    not where it was compared as (member, hub) before. Blocks first meet with
    their sketches; only members that have a candidate come again with their
    texts, and what leaves a task then is links alone.
    """
    least = least_agreement(threshold)
    placed = bucketed.join(roots, F.col("cid") == F.col("child"), "left").select("bh", "cid", "hub", "bytes", F.coalesce("parent", "cid").alias("comp"))
    placed = written(placed, "placed")
    used.append(placed)
    rows = _blocks(placed, used)

    def candidates(key: tuple, t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        bh = key[0].as_py()
        cid, comp, hub, side = (t[c].to_numpy() for c in ("cid", "comp", "hub", "side"))
        outside = t["outside"].to_numpy(zero_copy_only=False)
        band = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        low = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(-1, T)
        members = np.flatnonzero(side == 0)
        for x in np.flatnonzero(side == 1):
            # Two outsiders meet in two places, and are compared in one.
            y = members[(comp[members] != comp[x]) & (cid[members] != hub[x]) & (cid[x] != hub[x]) & (~outside[members] | (cid[members] > cid[x]))]
            if len(y):
                y = y[(low[y] == low[x]).sum(1) >= least]
            if len(y):
                y = y[band[x][(band[y] == band[x]).argmax(1)] == bh]
            if len(y):
                yield int(x), y

    def involved(key: tuple, t: pa.Table) -> pa.Table:
        hit = np.zeros(t.num_rows, bool)
        for x, y in candidates(key, t):
            hit[x] = hit[y] = True
        return t.select(["bh", "i", "j", "side", "cid", "hub", "comp", "outside"]).filter(pa.array(hit))

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        cid, comp = t["cid"].to_numpy(), t["comp"].to_numpy()
        s, at = shingle_sets(t["t"].combine_chunks(), size)
        forest, found = Forest(), []
        for x, y in candidates(key, t):
            for k in y.tolist():
                # What this block's links have joined already needs no further link.
                p, q = int(comp[x]), int(comp[k])
                if forest.root(p) != forest.root(q) and similar(s[at[x] : at[x + 1]], s[at[k] : at[k + 1]], threshold):
                    forest.join(p, q)
                    found.append((int(cid[x]), int(cid[k])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    some = rows.join(nodes.select("cid", "bands", "low"), "cid").groupBy("bh", "i", "j").applyInArrow(involved, rows.schema)
    some = written(some, "involved")
    used.append(some)
    some = some.join(nodes.select("cid", "bands", "low", "t"), "cid")
    return some.groupBy("bh", "i", "j").applyInArrow(meet, "a long, b long")


def _resolved(docs: DataFrame, size: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """id, address, n, key, and the least (id, address) of the component: ``top``; null where nothing can link. docs: settled."""
    sig = written(signatures(docs, size, id_col, text_col), "signatures")
    rep = F.min(F.struct("id", "file", "row")).alias("rep")
    reps = sig.where("key is not null and id is not null").groupBy("key").agg(rep, F.count("*").alias("n_rows"), F.min(F.struct("bytes", "file", "row")).alias("short"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    # Classes are numbered as they are written, so the numbers are fixed from here on.
    reps = written(reps.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # Equal sets may have texts of very different length: the shortest stands for the class.
    rows = reps.select("cid", "short.bytes", F.explode("bands").alias("bh"))
    hubs = written(rows.groupBy("bh").agg(F.min("cid").alias("hub"), F.count("*").alias("size")).where("size > 1"), "hubs")
    bucketed = written(join_unique(rows, hubs, "bh", "size"), "bucketed")
    light = reps.join(bucketed.select("cid").hint("merge"), "cid", "left_semi").select("cid", "short.file", "short.row", "short.bytes", "bands", "low")
    texts = addressed(docs, F.col(text_col).alias("t"))
    nodes = written(light.hint("merge").join(texts, ["file", "row"]).select("cid", "bytes", "bands", "low", "t"), "nodes")
    star = written(bucketed.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct(), "star")
    used: list[DataFrame] = []
    agreeing = written(_against_hubs(star, nodes, "low", _sketch_check(least_agreement(threshold)), used), "agreeing")
    first = written(_against_hubs(agreeing, nodes, "t", _text_check(size, threshold), used), "first")
    roots = components(first)
    rest = written(_across(bucketed, nodes, roots, size, threshold, used), "rest")
    used += [bucketed, nodes, star, agreeing, first, rest, roots]
    if not rest.isEmpty():
        roots = components(roots.toDF("a", "b").union(rest))
        used.append(roots)
    classes = written(reps.select("key", "rep", "n_rows", "cid").join(roots, F.col("cid") == F.col("child"), "left").select("key", "rep", "n_rows", F.coalesce("parent", "cid").alias("root")), "rooted")
    tops = written(classes.groupBy("root").agg(F.min("rep").alias("top"), F.count("*").alias("n")), "component-tops")
    by_key = written(join_unique(classes.drop("rep"), tops, "root", "n").select("key", "top", "n_rows"), "by-key")
    dropped(reps, hubs, classes, tops, *used)
    narrow = sig.select("id", "file", "row", "n", "key")
    able = F.col("key").isNotNull() & F.col("id").isNotNull()
    unable = narrow.where(~able).withColumn("top", F.lit(None).cast(by_key.schema["top"].dataType))
    return join_unique(narrow.where(able), by_key, "key", "n_rows").unionByName(unable)


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id linked, over any number of links) and kept per row."""
    out = _resolved(settled(docs), size, threshold, id_col, text_col)
    root = F.coalesce(F.col("top.id"), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of repeated rows one; all columns as they are.

    Rows without words or without an id link with nothing and all stay.
    """
    docs = settled(docs)
    gone = _resolved(docs, size, threshold, id_col, text_col).where("top is not null and (file <> top.file or row <> top.row)").select("file", "row")
    rows = addressed(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("in"))
    return rows.join(gone.hint("merge"), ["file", "row"], "left_anti").select("in.*")
