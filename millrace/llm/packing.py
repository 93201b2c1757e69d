"""Packing documents into sequences: patterns by non-negative least squares.

Documents are tokenised and cut into pieces of at most a sequence's length. The
histogram of piece lengths (at most one count per length, whatever the corpus)
goes to the driver. There, patterns of a few length classes that fill a
sequence are enumerated; how often to repeat each is fitted to the histogram by
non-negative least squares and rounded; what is left is packed best-fit, largest
first, into the remaining room of the patterns and then into new sequences. The
plan says for the r-th piece of a length where it goes. Its size follows the
number of different lengths and not the number of pieces.

Defined results: a null or empty text is one piece of the end id; repeated rows
are packed as rows of their own; an empty table gives an empty result; pieces
of equal length are interchangeable, so any of them may take any of its places.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions.spread import spread
from millrace.llm.common import more_fields, written
from millrace.llm.words import SPACES, Known, gathered, slices, words

#: Marks that the pre-tokeniser always parts from the letters before them.
MARKS = ".,!?*#$%&;:"

#: Groups of tasks within which pieces of a length are numbered: the least and the most.
GROUPS, MOST_GROUPS = 64, 1024

_VOCABULARIES: dict[int, Vocabulary] = {}


class Vocabulary:
    """A word-end vocabulary on a worker: ids of words as bytes of 32-bit integers."""

    def __init__(self, spec: bytes):
        import json

        from tokenizers import Tokenizer

        told = json.loads(spec)
        # Cutting is exact where spaces vanish and no added token holds a space or mark.
        if any(set(t["content"]) & set(SPACES + MARKS) for t in told["added_tokens"]):
            raise ValueError("an added token holds white space or a mark")
        self.added = [t["content"].lower().encode() for t in told["added_tokens"]]
        self.library = Tokenizer.from_str(spec.decode())
        end, vocab = told["model"]["end_of_word_suffix"], told["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end)]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        # Words of letters end at the first id that ends a word, so many of them are encoded as one text.
        plain = [w.isascii() and w.isalpha() for w in words]
        letters = [w for w, p in zip(words, plain, strict=True) if p]
        some = [" ".join(letters[k : k + 1000]) for k in range(0, len(letters), 1000)]
        ids = np.array([i for e in self.library.encode_batch_fast(some, add_special_tokens=False) for i in e.ids], np.uint32)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        data = ids.tobytes()
        of_letters = iter([data[a:z] for a, z in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)] if letters else [])
        others = iter(self.library.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        return [next(of_letters) if p else array("I", next(others).ids).tobytes() for p in plain]


def _vocabulary(spec: bytes) -> Vocabulary:
    """This worker's vocabulary; loaded once."""
    key = zlib.crc32(spec)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(spec)
    return _VOCABULARIES[key]


def encode_words(vocabulary: Vocabulary, texts: pa.Array, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and where each text begins in it; known: of the vocabulary's encode.

    They are what the library gives for whole texts: the vocabulary's normaliser
    drops white space and makes capitals small, its pre-tokeniser never crosses
    white space and parts letters from the marks after them.
    """
    found, code, bounds = words(texts, lower=True, marks=MARKS, spare=vocabulary.added)
    ids, ends = gathered(known.of(found), code)
    return ids, ends[bounds]


def tokenised_pieces(docs: DataFrame, spec: bytes, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, part, rank and, where asked, ids.

    part: the task's number; rank: the piece's place among the task's pieces of
    its length. Write the rows before use, so that ranks are fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocabulary = _vocabulary(shared.value)
        part, seen, end, known = TaskContext.get().partitionId(), defaultdict(int), np.array([end_id], np.uint32), Known(vocabulary.encode)
        for whole in batches:
            for b in slices(whole, 1):
                ids, at = encode_words(vocabulary, b.column(1), known)
                # The end id goes behind each text's own.
                ids, at = np.insert(ids, at[1:], end), at + np.arange(len(at))
                rows: list[tuple] = []
                for k, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for p, start in enumerate(range(a, z, capacity)):
                        length = min(z - start, capacity)
                        rows.append((k, p, start - a, length, zlib.crc32(ids[start : start + length]), seen[length], start))
                        seen[length] += 1
                cols = list(zip(*rows, strict=True))
                out = [b.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]], pa.array(np.full(len(rows), part, np.int32)), pa.array(cols[5], pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array([*cols[6], len(ids)], pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * with_ids
    schema = more_fields(docs.select(F.col(id_col)).schema, "piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids)
    return spread(docs.select(F.col(id_col), F.col(text_col).alias("_text"))).mapInArrow(run, schema)


# The plan -------------------------------------------------------------------


def patterns(classes: int, most: int, usable: np.ndarray) -> list[tuple[int, ...]]:
    """All ways to write ``classes`` as at most ``most`` descending usable parts."""
    found = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < most:
            for part in range(min(left, head[-1] if head else left), 0, -1):
                if part * (most - len(head)) < left:
                    break
                if usable[part]:
                    extend((*head, part), left - part)

    extend((), classes)
    return found


def least_squares(a: np.ndarray, h: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes a @ x close to h, by accelerated projected gradient steps."""
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (a.T @ (a @ y - h)), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def pack(histogram: dict[int, int], capacity: int, most: int = 3, classes: int = 256, share: float = 0.8) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) of a plan that places every piece.

    Equal sequences are one entry, so the plan's size follows the number of
    different lengths and not the number of pieces. share: the part of the fitted
    repeats that is laid out as patterns; the rest keeps pieces of every size for
    the residual, which fills the patterns' rounding gaps.
    """
    left = {int(n): int(c) for n, c in histogram.items() if c}
    plan: list[tuple[tuple[int, ...], int]] = []
    if left.get(capacity):
        plan.append(((capacity,), left.pop(capacity)))
    width = -(-capacity // classes)
    classes = capacity // width
    cls = {n: -(-n // width) for n in left}
    have = np.zeros(classes + 2)
    for n, c in left.items():
        if cls[n] <= classes:
            have[cls[n]] += c
    groups: list[list] = []  # [room, lengths, how many]
    ways = patterns(classes, most, have > 0)
    if ways:
        a = np.zeros((classes + 1, len(ways)))
        for j, way in enumerate(ways):
            for part in way:
                a[part, j] += 1
        # Large pieces are hard to place later, so their misfit weighs more.
        weight = np.sqrt(np.arange(classes + 1) / classes)
        x = least_squares(a * weight[:, None], have[: classes + 1] * weight)
        stock = defaultdict(list)  # class: [length, count], longest last
        for n in sorted(left):
            stock[cls[n]].append([n, left[n]])
        for j in np.argsort(-x, kind="stable"):
            need = a[:, j]
            n = int(min(np.floor(share * x[j] + 0.5), min(have[p] // need[p] for p in set(ways[j]))))
            if n <= 0:
                continue
            runs = []
            for part in ways[j]:
                have[part] -= n
                run, want = [], n
                while want:
                    top = stock[part][-1]
                    take = min(want, top[1])
                    run.append([top[0], take])
                    top[1] -= take
                    want -= take
                    if not top[1]:
                        stock[part].pop()
                runs.append(run)
            while runs[0]:
                take = min(r[0][1] for r in runs)
                lengths = tuple(r[0][0] for r in runs)
                groups.append([capacity - sum(lengths), lengths, take])
                for r in runs:
                    r[0][1] -= take
                    if not r[0][1]:
                        r.pop(0)
        left = {n: c for rows in stock.values() for n, c in rows}
    return plan + best_fit(left, groups, capacity)


def best_fit(left: dict[int, int], groups: list[list], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Largest first, each piece into the fullest sequence that has room, else a new one."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for room, lengths, n in groups:
        rooms[room].append((lengths, n))
    free = np.zeros(capacity + 1, bool)
    free[[r for r in rooms]] = True

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        rooms[room].append((lengths, n))
        free[room] = True

    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            room = length + int(free[length:].argmax()) if free[length:].any() else -1
            if room < 0:
                each = capacity // length
                full, rest = divmod(count, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            lengths, n = rooms[room].pop()
            if not rooms[room]:
                free[room] = False
            each = min(room // length, count)
            use = min(n, count // each)
            put(room - each * length, lengths + (length,) * each, use)
            if n > use:
                put(room, lengths, n - use)
            count -= each * use
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for rows in rooms.values():
        for lengths, n in rows:
            merged[tuple(sorted(lengths, reverse=True))] += n
    return list(merged.items())


def segments(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, first sequence, pieces a sequence, first offset)."""
    rows, used, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, n in plan:
        at = 0
        for length in dict.fromkeys(lengths):
            times = lengths.count(length)
            rows[length].append((used[length], sequence, times, at))
            used[length] += n * times
            at += times * length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (written) with sequence_id and offset instead of part and rank.

    Pieces as long as a sequence are one each, named by their task and place. A
    shorter piece's number among those of its length is its place within one of
    the groups of tasks, by a sort, and what the groups before it hold: there is a
    group for every eight tasks, so that table has at most MOST_GROUPS rows a length.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("part", "rank")]
    groups = min(MOST_GROUPS, max(GROUPS, (pieces.agg(F.max("part")).first()[0] or 0) // 8))
    group = F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int")
    # Numbers below 0 name full sequences: a task's number and 40 bits of place.
    alone = -1 - (F.col("part").cast("long") * (1 << 40) + F.col("rank"))
    full = pieces.where(F.col("length") == capacity).select(*names, alone.cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Nested, so that no column of the caller's meets one of these.
    held = pieces.where(F.col("length") < capacity).select(F.struct(*names).alias("p"), F.col("length").alias("n"), group.alias("g"), "part", "rank")
    counts = held.groupBy("n", "g").agg(F.count("*").alias("c")).toArrow()
    before = np.zeros((capacity + 1, groups), np.int64)
    before[counts["n"].to_numpy(), counts["g"].to_numpy()] = counts["c"].to_numpy()
    total = before.sum(1)
    before = np.cumsum(before, 1) - before
    shared = spark.sparkContext.broadcast((segments(pack({n: int(total[n]) for n in np.flatnonzero(total).tolist()}, capacity)), before))
    place = F.row_number().over(Window.partitionBy("n", "g").orderBy("part", "rank")) - 1
    ranked = held.select("p", "n", "g", place.cast("long").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before = shared.value
        for b in batches:
            length = b.column("n").to_numpy()
            rank = b.column("r").to_numpy() + before[length, b.column("g").to_numpy()]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                n = int(length[own[0]])
                rows = plan[n]
                at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                j = rank[own] - at[:, 0]
                sequence[own] = at[:, 1] + j // at[:, 2]
                offset[own] = at[:, 3] + j % at[:, 2] * n
            yield pa.RecordBatch.from_arrays([*b.column("p").flatten(), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")).unionByName(full)


def pack_documents(docs: DataFrame, spec: bytes, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack_pieces(written(tokenised_pieces(docs, spec, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)
