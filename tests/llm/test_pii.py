import random
import re

import numpy as np
from millrace.llm import pii

BRUTE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for kind, p in BRUTE.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == "email"
                or (kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            )
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_is_the_patterns():
    rnd = random.Random(3)
    parts = ["4532015112830366", "4532 0151-1283 0366", "+1 (269) 555-3296", "a.b@c.d", "@", ".", "-", " ", "1.2.3.4", "255", "256.1.1.1", "x", "_", "+", "é", "(", "12", "a@b", "0", "😀", "1" * 20]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))
        assert pii.find_base(text) == brute(text), text


def test_scans_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "a@" * 150_000, "+1" + "(" * 300_000, "+" * 300_000, "1 " * 200_000, "[(" * 100_000, "a [at] " * 50_000):
        pii.find_loose(text, pii.find_base(text))


def test_very_long_numbers():
    zeros = "0" * 5000
    text = f"{zeros}1.2.3.{zeros} {zeros}256.1.1.1 1.1.1.1{'9' * 5000}"
    assert pii.find_base(text) == brute(text) and len([s for s in pii.find_base(text) if s[0] == "ip"]) == 1


def test_classifier_sees_more_than_votes():
    # Equal votes, other shapes: the longer form comes with strong votes elsewhere, the shorter with weak ones.
    strong, weak = "phone base yyyy-y", "phone loose n-n--n"
    histogram = {f"{strong} 21as": 0} | {f"{strong} 21aa": 200, f"{weak} 02dd": 200, "phone loose ny---y 21aa": 3, "phone loose ny---y 02dd": 3}
    model = pii.fit_counts({k: v for k, v in histogram.items() if v})
    assert model.accepts("phone loose ny---y 21aa") != model.accepts("phone loose ny---y 02dd")
    assert pii.shape("call 555-1234 now", "phone", 5, 13) == "01aa" and pii.shape("(1)", "card", 0, 3) == "03nn"


def test_registered_rows_against_brute_force(spark):
    import hashlib

    from millrace.llm.queries import QUERIES

    from ..conftest import SF

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        found = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(f[0] == k for f in found) for k in pii.KINDS]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and {*base.split(",")} - {""} <= {*r["spans"].split(",")}


def test_clashing_columns(docs_of):
    docs = docs_of(["a b@c.de x"]).withColumnsRenamed({"lang": "_text", "source": "base", "n_chars": "spans"})
    assert pii.find_pii(docs, pii.fit(docs)).collect()[0]["n_email"] == 1
    assert pii.redact(docs, pii.fit(docs)).columns == docs.columns


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = (0.95, 0.9, 0.6)
    cast = ["".join("y" if (t == (rng.random() < r)) else "n" for r in right) for t in truth]
    kinds, counts = np.unique(cast, return_counts=True)
    post, rel = pii.em(list(kinds), counts)
    guess = dict(zip(kinds, post > 0.5, strict=True))
    assert np.mean([guess[c] == t for c, t in zip(cast, truth, strict=True)]) > 0.93
    assert rel[0, 0] > rel[0, 2]


def test_proposed_spans_are_added_and_base_stays(docs_of):
    clean = ["the quick brown fox"] * 30
    base = [f"mail me at user{i}@mail.example.com or call +1 (269) 555-32{i:02d} card 4532015112830366 ip 10.2.3.{i}" for i in range(40)]
    glued = ["my card number 555-3296 4532015112830366 thanks"]  # base takes one run of too many digits
    docs = docs_of(clean + base + glued)
    rows = {r["doc_id"]: r for r in pii.find_pii(docs, pii.fit(docs)).collect()}
    assert all(not rows[i]["spans"] for i in range(30))
    assert all(set(rows[i]["base"].split(",")) <= set(rows[i]["spans"].split(",")) for i in range(30, 70))
    assert all((rows[i]["n_email"], rows[i]["n_ip"], rows[i]["n_card"], rows[i]["n_phone"]) == (1, 1, 1, 1) for i in range(30, 70))
    assert rows[70]["base"] == "" and "card:24:40" in rows[70]["spans"]


def test_odd_rows(odd_docs, no_docs):
    assert pii.find_pii(odd_docs, pii.fit(odd_docs)).count() == odd_docs.count()
    model = pii.fit(no_docs)
    assert pii.find_pii(no_docs, model).count() == 0 and not model.probability


def test_redaction(docs_of):
    docs = docs_of(["a b@c.de x", None, "+1 (269) 555-3296 4532015112830366"])
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.fit(docs)).collect()}
    assert out[0] == "a [EMAIL] x" and out[1] is None
    assert pii.redact_text("0123456789", [("ip", 2, 6), ("card", 4, 8)]) == "01[IP]89"
