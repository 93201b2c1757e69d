"""A quality classifier: naive Bayes features under a linear support vector machine.

A text is the set of its n-grams: hashed words, hashed pairs of neighbouring
words, and one to three neighbouring word forms (case, closing mark, length, and
whether the word repeats the one before). Each indicator is scaled by its log-count ratio between the classes; a
hinge-loss linear model is fitted on the scaled rows by dual coordinate descent,
and a logistic curve turns its margin into a score.

The fit takes at most ``sample_rows`` labelled rows (a parameter), drawn by a
hash of the id. Executors send hashed n-gram sets, at most DIMS numbers a text,
however long it is. Scoring reads every row once and needs no shuffle.

Defined results: a null or empty text has no n-grams and gets the score of the
model's bias; with no labels of one class, all texts score the smoothed share
of ones; a null id is never held out; repeated rows each get a row; an empty
table gives an empty result. Rows travel nested, so columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spread import spread
from millrace.llm.common import mix64, more_fields
from millrace.llm.words import slices, words

WORDS, PAIRS = 1 << 17, 1 << 18
FORMS = 64
DIMS = WORDS + PAIRS + FORMS + FORMS**2 + FORMS**3
#: Parts of the labelled rows, each judged by weights of the others, for the logistic curve.
FOLDS = 5


def _form(word: str) -> int:
    """Case (4) x closing mark (4) x length (2)."""
    case = 2 if word.isupper() and len(word) > 1 else 1 if word[0].isupper() else 0 if any(c.isalpha() for c in word) else 3
    last = word[-1]
    mark = 0 if last.isalnum() else 1 if last in ".,;:?" else 2 if last == "!" else 3
    return case * 8 + mark * 2 + (len(word) > 14)


def _packed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) << 8 | _form(word)


def ngram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram numbers of all texts in one array, and where each text's begin."""
    found, code, at = words(texts)
    packed = np.fromiter(map(_packed, found), np.int64, len(found))[code]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    near, nearer = text[1:] == text[:-1], text[2:] == text[:-2]
    word, form = packed >> 8, packed & 255
    form[1:] += 32 * (near & (packed[1:] == packed[:-1]))
    pair = (mix64((word[:-1].astype(np.uint64) << np.uint64(32)) | word[1:].astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
    two = form[:-1] * FORMS + form[1:]
    three = two[:-1] * FORMS + form[2:]
    base = text * DIMS
    first = WORDS + PAIRS
    groups = [base + word % WORDS, base + first + form, (base[1:] + WORDS + pair)[near], (base[1:] + first + FORMS + two)[near], (base[2:] + first + FORMS + FORMS**2 + three)[nearer]]
    ids = np.concatenate(groups)
    ids.sort()
    ids = ids[np.append(True, ids[1:] != ids[:-1])] if len(ids) else ids
    return (ids % DIMS).astype(np.int32), np.searchsorted(ids, np.arange(len(at)) * DIMS)


@dataclass
class QualityModel:
    """weight: of each scaled indicator times its scale; square: of each scale."""

    weight: np.ndarray
    square: np.ndarray
    slope: float
    bias: float

    def margins(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text (its n-grams in ids from at), 0 where it has none."""
        of, n = np.repeat(np.arange(len(at) - 1), np.diff(at)), len(at) - 1
        length = np.sqrt(np.bincount(of, self.square[ids], n))
        return np.bincount(of, self.weight[ids], n) / np.maximum(length, 1e-9)

    def scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * self.margins(ids, at), -40, 40)))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 3) -> np.ndarray:
    """Weights over unscaled indicators of a hinge-loss linear model on scaled unit rows.

    Each step solves one dual variable, kept in [0, cost], exactly.
    """
    w = np.zeros(len(scale))
    x = [scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-9) for r in rows]
    q = np.array([float(v @ v) for v in x])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if q[i] == 0:
                continue
            grad = sign[i] * float(w[rows[i]] @ x[i]) - 1
            new = min(max(alpha[i] - grad / q[i], 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * sign[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _linear(rows: list[np.ndarray], label: np.ndarray, smoothing: float) -> QualityModel:
    """Log-count ratios and the hinge-loss weights over them; not yet calibrated."""
    counts = np.zeros((2, DIMS))
    for r, y in zip(rows, label, strict=True):
        counts[int(y), r] += 1
    counts += smoothing
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w = dual_descent(rows, ratio, np.where(label > 0, 1.0, -1.0))
    return QualityModel((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), 1.0, 0.0)


def fit_rows(rows: list[np.ndarray], label: np.ndarray, smoothing: float = 1.0) -> QualityModel:
    """The model of n-gram sets and their labels 0 or 1."""
    ones = int(label.sum())
    if not 0 < ones < len(label):
        share = (ones + 1) / (len(label) + 2)
        return QualityModel(np.zeros(DIMS, np.float32), np.ones(DIMS, np.float32), 0.0, float(np.log(share / (1 - share))))
    model = _linear(rows, label, smoothing)
    # Margins of rows that the weights were not fitted on: those of their own rows are all too sure.
    fold = np.arange(len(rows)) % FOLDS
    margin, judged = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if 0 < label[rest].sum() < len(rest) and len(own):
            ids = [rows[i] for i in own]
            margin[own] = _linear([rows[i] for i in rest], label[rest], smoothing).margins(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
            judged[own] = True
    if not judged.any():
        margin, judged = model.margins(np.concatenate(rows), np.cumsum([0, *map(len, rows)])), ~judged
    margin, label = margin[judged], label[judged]
    ones = int(label.sum())
    # A logistic curve through the margins, on smoothed targets.
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x, ab = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * ab)
        ab -= step
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.bias = float(ab[0]), float(ab[1])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000) -> QualityModel:
    """A model of at most sample_rows labelled rows that are not held out: those whose ids have the smallest hashes.

    The bounded sample of labels is broadcast, so the documents aren't moved. Of an
    id with several texts one is taken, the one with the smallest hash; an id that
    has both labels counts once with each.
    """
    drawn = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    drawn = drawn.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample_rows)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                ids, at = ngram_sets(b.column("_text"))
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=["_id", "_y", "ids"])

    # Each task keeps one text of an id, so repeated ids don't unbound what is sent.
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("t")
    rows = text.join(F.broadcast(drawn.distinct()), "_id").groupBy("_id", "_y").agg(one).select("_id", "_y", "t._text").mapInArrow(run, more_fields(text.select("_id").schema, "_y int, ids array<int>"))
    got = rows.toArrow().sort_by([("_id", "ascending"), ("_y", "ascending")])  # sample_rows at most
    sets = got["ids"].combine_chunks()
    ids, at = sets.flatten().to_numpy(), np.append(0, np.cumsum(sets.value_lengths().to_numpy()))
    return fit_rows([ids[a:z] for a, z in zip(at[:-1], at[1:], strict=True)], got["_y"].to_numpy())


def _scored(docs: DataFrame, model: QualityModel, text_col: str, keep: list[str]) -> DataFrame:
    """The keep columns nested in ``in``, and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = spread(docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("in"), docs[f"`{text_col}`"].alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("in"), pa.array(shared.value.scores(*ngram_sets(b.column("text"))))], names=["in", "score"])

    return rows.mapInArrow(run, rows.select("in").schema.add("score", "double"))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The keep columns (all, where not given) and a double between 0 and 1 per row."""
    return _scored(docs, model, text_col, docs.columns if keep is None else keep).select("in.*", F.col("score").alias(column))


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns as they are."""
    return _scored(docs, model, text_col, docs.columns).where(F.col("score") >= least).select("in.*")
