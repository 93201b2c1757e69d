"""Personal data by weak supervision.

Base patterns find spans of four kinds exactly. Looser patterns propose further
spans. For every span, labelers (patterns, gazetteers, context words) vote yes,
no or nothing. Expectation-maximisation over the counts of vote patterns in the
whole corpus estimates each labeler's reliability; a logistic classifier of
spans is then trained on the posteriors. Besides the votes it sees what no
labeler looks at: the span's length and separators, and the kinds of character
on both sides. Base spans always stay; proposed ones are added where the
classifier is sure.

What reaches the driver is a histogram of vote patterns and shapes, whose size
is bounded by the labelers (at most 4 kinds x 2 x 72 patterns x 256 shapes) and
not by the corpus.

Defined results: a null text counts as empty; offsets are code points, end
exclusive; every scan is linear in the text's length; repeated rows each get a
row; an empty table gives an empty result and a model that adds nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.spread import spread
from millrace.llm.words import slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start alone: where it fails there, it fails from within.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]{1,63}+)+"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{16}|3[47][0-9]{13}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+|00)?(?:[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}

# Gazetteers and context words.
_TLDS = frozenset("com org net edu gov info io de fr es it uk eu us ca ru ch nl be at pl biz".split())
_RESERVED_IP = ("0.", "127.", "255.", "224.", "239.")
_CONTEXT = {
    "email": ("mail", "contact", "write to", "correo", "courriel", "kontakt", "reach"),
    "ip": ("ip", "host", "server", "address", "adresse", "login", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "numéro", "llama"),
}
#: Lengths at which a span of a kind counts as longer.
_LENGTHS = {"email": (12, 20, 40), "ip": (9, 16, 30), "card": (16, 18, 20), "phone": (11, 14, 17)}
_AGAINST = ("isbn", "order", "invoice", "version", "sku", "serial", "ticket", "ref", "issue", "article", "page", "§", "€", "$", "=")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, looking left of each @ no further than its own run."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        n = len(local) - len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if n else None
        free = m.end() if m else at + 1
        if m:
            found.append((at - n, m.end()))
        at = text.find("@", free)
    return found


def find_base(text: str) -> list[tuple[str, int, int]]:
    """The base spans (kind, start, end), by kind as listed and then start."""
    found = [("email", s, e) for s, e in find_emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def find_loose(text: str, base: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans that touch no base span, leftmost non-overlapping per kind."""
    found = []
    if any(c in text for c in "[({"):
        found += [("email", m.start(), m.end()) for m in _LOOSE["email"].finditer(text)]
    if _DIGIT.search(text):
        for kind in KINDS[1:]:
            found += [(kind, m.start(), m.end()) for m in _LOOSE[kind].finditer(text)]
    return [f for f in found if all(f[2] <= s or e <= f[1] for _, s, e in base)] if found else found


def _vote(yes: bool, no: bool) -> str:
    return "y" if yes else "n" if no else "-"


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One letter per labeler (y, n or -): pattern, form, gazetteer, context, contrary context, edges."""
    span, digits = text[start:end], _digits(text[start:end]) if kind != "email" else ""
    before = text[max(0, start - 40) : start].lower()
    if kind == "email":
        form, odd = bool(re.search(r"\.[A-Za-z]{2,}$", span)), ".." in span or len(span) > 254
        known = re.split(r"[.\])}\s]+", span.lower())[-1]
        listed, unlisted = known in _TLDS, known.isdigit()
    elif kind == "ip":
        form, odd = not re.search(r"(^|\.)0[0-9]", span), len(span) < 7
        unlisted = span.startswith(_RESERVED_IP)
        listed = not unlisted
    elif kind == "card":
        form, odd = luhn(digits), not luhn(digits)
        listed = digits[:1] in "3456"
        unlisted = not listed
    else:
        form, odd = 10 <= len(digits) <= 13, not 8 <= len(digits) <= 15
        listed, unlisted = span[0] == "+" or span.startswith("00"), digits[:1] == "0" and span[:2] != "00"
    joined = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return (
        _vote(base, not base)
        + _vote(form, odd)
        + _vote(listed, unlisted)
        + _vote(any(w in before for w in _CONTEXT[kind]), False)
        + _vote(False, any(w in before for w in _AGAINST))
        + _vote(not joined, joined)
    )


def _beside(c: str) -> str:
    """The kind of the nearest character beside a span: n none, a letter, d digit, o other."""
    return "n" if not c else "a" if c.isalpha() else "d" if c.isdigit() else "o"


def shape(text: str, kind: str, start: int, end: int) -> str:
    """One character each for length, separators, and what stands before and after; 256 shapes at most."""
    size = end - start
    long = "0123"[sum(size >= x for x in _LENGTHS[kind])]
    apart = {c for c in text[start:end] if not c.isalnum()}
    marks = "0" if not apart else "3" if apart & set("()[]{}") else "1" if len(apart) == 1 else "2"
    return long + marks + _beside(text[max(0, start - 3) : start].strip()[-1:]) + _beside(text[end : end + 3].strip()[:1])


def pattern_key(text: str, span: tuple[str, int, int], base: bool) -> str:
    return f"{span[0]} {'base' if base else 'loose'} {votes(text, *span, base)} {shape(text, *span)}"


def features(key: str) -> list[float]:
    """What the classifier sees of a key: kind, votes, and the shape, its length for each kind apart.

    The base pattern's vote is left out; it is constant on what is judged.
    """
    kind, _, cast, form = key.split(" ")
    seen = [1.0, *(float(kind == k) for k in KINDS), *(float(c == "y") - float(c == "n") for c in cast[1:])]
    seen += [float(kind == k and form[0] == x) for k in KINDS for x in "0123"]
    return seen + [float(form[1] == x) for x in "0123"] + [float(form[i] == x) for i in (2, 3) for x in "nado"]


@dataclass
class PiiModel:
    """The span classifier: which proposed spans count as personal data."""

    threshold: float = 0.9
    reliability: dict[str, list[float]] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    probability: dict[str, float] = field(default_factory=dict)  # of keys met

    def accepts(self, key: str) -> bool:
        if key not in self.probability:
            z = sum(w * x for w, x in zip(self.weights, features(key), strict=True))
            self.probability[key] = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return self.probability[key] >= self.threshold

    def spans(self, text: str | None) -> tuple[list, list]:
        """Base spans and all spans, each by kind as listed and then start."""
        text = text or ""
        base = find_base(text)
        loose = find_loose(text, base) if self.weights else []
        added = [s for s in loose if self.accepts(pattern_key(text, s, False))]
        order = {k: i for i, k in enumerate(KINDS)}
        return base, sorted([*base, *added], key=lambda s: (order[s[0]], s[1])) if added else base


def em(patterns: Sequence[str], counts: Sequence[float], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior per vote pattern, and per labeler the chance of a yes in each class.

    Two-class Dawid and Skene over pattern counts; abstentions say nothing. The
    prior counts (2 right, 1 wrong) keep reliabilities inside (0, 1).
    """
    yes = np.array([[c == "y" for c in p] for p in patterns], float)
    no = np.array([[c == "n" for c in p] for p in patterns], float)
    n = np.asarray(counts, float)
    post = (yes.sum(1) + 1) / (yes.sum(1) + no.sum(1) + 2)
    for _ in range(rounds):
        w1, w0 = n * post, n * (1 - post)
        prior = (w1.sum() + 1) / (n.sum() + 2)
        a = (w1 @ yes + 2) / (w1 @ (yes + no) + 3)
        b = (w0 @ yes + 1) / (w0 @ (yes + no) + 3)
        logit = np.log(prior / (1 - prior)) + yes @ np.log(a / b) + no @ np.log((1 - a) / (1 - b))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, np.stack([a, b])


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + penalty * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, text_col: str = "text", threshold: float = 0.9) -> PiiModel:
    """A model from the vote patterns of all spans in docs; one pass, a tiny shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for whole in batches:
            for b in slices(whole, 0):
                for text in b.column(0).to_pylist():
                    if text:
                        base = find_base(text)
                        seen.update(pattern_key(text, s, True) for s in base)
                        seen.update(pattern_key(text, s, False) for s in find_loose(text, base))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

    rows = spread(docs.select(F.col(text_col))).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return fit_counts({r["key"]: r["n"] for r in rows}, threshold)


def fit_counts(histogram: dict[str, int], threshold: float = 0.9) -> PiiModel:
    """The model of a histogram of vote patterns."""
    model = PiiModel(threshold)
    keys = sorted(histogram)
    if not keys:
        return model
    post = np.zeros(len(keys))
    for kind in KINDS:
        own = [i for i, k in enumerate(keys) if k.split(" ")[0] == kind]
        if own:
            # The first letter is the base pattern itself; it votes like the others. Shapes don't vote.
            post[own], rel = em([keys[i].split(" ")[2] for i in own], [histogram[keys[i]] for i in own])
            model.reliability[kind] = rel.ravel().tolist()
    x = np.array([features(k) for k in keys])
    n = np.array([histogram[k] for k in keys], float)
    w = logistic(x, post, n)
    model.weights = w.tolist()
    return model


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (string), spans (string), and per kind the number of base spans; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                got = [model.spans(t) for t in b.column(1).to_pylist()]
                counts = [Counter(s[0] for s in base) for base, _ in got]
                cols = [b.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS], pa.array([joined(base) for base, _ in got], pa.string()), pa.array([joined(s) for _, s in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *[f"n_{k}" for k in KINDS], "base", "spans"])

    schema = docs.select(F.col(id_col)).schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return spread(docs.select(F.col(id_col), F.col(text_col).alias("_text"))).mapInArrow(run, schema.add("base", "string").add("spans", "string"))


def redact_text(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced; null texts stay null, other columns as they are, whatever their names."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("in"))
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            kinds = list(whole.schema.field("in").type)
            flat = pa.RecordBatch.from_arrays(whole.column("in").flatten(), names=[str(n) for n in range(len(kinds))])
            for b in slices(flat, k):
                text = [t and redact_text(t, model.spans(t)[1]) for t in b.column(k).to_pylist()]
                columns = [pa.array(text, c.type) if n == k else c for n, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=kinds)], names=["in"])

    return spread(rows).mapInArrow(run, rows.schema).select("in.*")
