import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from millrace.llm import pieces
from millrace.llm.queries import vocabulary
from millrace.llm.words import Known

from ..conftest import SF
from .conftest import ODD

ALPHA = [*"ab cd  \n\t\r.,!éßñ中文😀▁\x00İ\u200b\u0301", "<s>", "</s>", "<unk>", "<0x0A>", "  ", "the", " of", "'s", "..."]


@pytest.fixture(scope="module")
def proto():
    return vocabulary("piece_bpe_32k.model")


def test_ids_are_the_librarys(proto):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ALPHA) for _ in range(rnd.randrange(50))) for _ in range(3000)] + [t or "" for t in ODD]
    library = pieces.model_of(proto).library
    encoder, counter = pieces.Encoder(pieces.model_of(proto)), pieces.Counter(pieces.model_of(proto))
    for some in (texts[:7], texts, [None, ""], []):
        some = pa.array(some, pa.string())
        n = counter.count(some)
        for text, (ids, ends), k in zip(some.to_pylist(), encoder.encode(some), n, strict=True):
            text = text or ""
            assert ids.tolist() == library.encode(text) and k == len(ids)
            assert len(ends) == len(ids) and (np.diff(ends) >= 0).all()
            assert not len(ends) or ends[-1] == len(text.encode())


def test_spans_hold_their_pieces(proto):
    text = "Hello  wörld\n😀 x"
    ((ids, ends),) = pieces.Encoder(pieces.model_of(proto)).encode(pa.array([text]))
    library, data, begin = pieces.model_of(proto).library, text.encode(), 0
    for i, end in zip(ids.tolist(), ends, strict=True):
        piece = library.id_to_piece(i)
        if not piece.startswith("<0x"):
            assert piece.replace(pieces.SPACE, " ").removeprefix(" " if begin == 0 else "") == data[begin:end].decode()
        begin = end


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_follows_the_character_map(rule):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = spm.SentencePieceNormalizer(rule_name=rule)
    model = pb.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    spec = model.normalizer_spec
    own = pieces.Normaliser(spec)
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(rnd.choice("abCD ﬁ①Å\u3000中ｶﾞé\u0301İß  \t") for _ in range(rnd.randrange(20)))
        normal, at = own.aligned(text)
        assert normal == library.normalize(text)
        assert len(at) == len(normal) + 1 and (np.diff(at) >= 0).all() and (not normal or at[-1] <= len(text.encode()))


def test_documents_round_trip(proto, odd_docs):
    rows = pieces.encode_documents(odd_docs, proto, outputs=("ids", "ends", "decoded", "ids_sha256", "n_tokens", "covered")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["ids"][0] == 1 and r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) == len(r["ends"]) + 2
        assert hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        assert r["decoded"] == (texts[r["doc_id"]] or "") and r["covered"] == len(r["decoded"].encode())


def test_decode_inverts(proto, docs_of, spark):
    docs = docs_of(["one two", "", "drei vier\nfünf"])
    ids = pieces.encode_documents(docs, proto, outputs=("ids",))
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(ids, proto).collect()} == {0: "one two", 1: "", 2: "drei vier\nfünf"}


def test_counts(proto, odd_docs, no_docs):
    library = pieces.model_of(proto).library
    texts = sorted((r["text"] or "") for r in odd_docs.collect())
    rows = pieces.count_tokens(odd_docs, proto, limit=100).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t)) for t in texts)
    assert sorted(r["n_bytes"] for r in rows) == sorted(len(t.encode()) for t in texts)
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    assert pieces.count_tokens(no_docs, proto).count() == 0
    assert pieces.encode_documents(no_docs, proto).count() == 0


def test_a_model_with_a_map(proto, docs_of):
    # The same vocabulary behind a character map and squeezed spaces: whole table against the library.
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    rule = pb.ModelProto()
    rule.ParseFromString(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model = pb.ModelProto()
    model.ParseFromString(proto)
    model.normalizer_spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = True
    mapped = model.SerializeToString()
    library = spm.SentencePieceProcessor(model_proto=mapped)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abCD ﬁ①Å\u3000中ｶﾞé\u0301İß  \t.,") for _ in range(rnd.randrange(30))) for _ in range(300)] + ODD
    rows = pieces.encode_documents(docs_of(texts), mapped, outputs=("ids", "ends"), bos=False, eos=False).collect()
    n = {r["doc_id"]: r["n_tokens"] for r in pieces.count_tokens(docs_of(texts), mapped).collect()}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text) and n[r["doc_id"]] == len(r["ids"])
        assert list(r["ends"]) == sorted(r["ends"]) and (not r["ends"] or r["ends"][-1] <= len(text.encode()))


def test_registered_rows_are_the_librarys(proto, spark):
    from millrace.llm.queries import QUERIES

    library = pieces.model_of(proto).library
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_token_counts"](spark, SF).collect():
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
    rows = QUERIES["op5_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [1, *library.encode(texts[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_cache_forgets(proto):
    model = pieces.model_of(proto)
    texts = [f"word{i} again and again." for i in range(50)]
    encoder = pieces.Encoder(model)
    encoder.chunks = Known(model.encode_chunks, entries=5)
    for t in texts:
        ((ids, _),) = encoder.encode(pa.array([t]))
        assert ids.tolist() == model.library.encode(t) and len(encoder.chunks.young) <= 5
    # The broadcast tier answers first; what it lacks comes from the library.
    counter = pieces.Counter(model, (pa.array([" again", " and"]), np.array([model.count_chunks([" again"])[0], 1])))
    assert counter.count(pa.array(texts)).tolist() == [len(model.library.encode(t)) for t in texts]
    assert " again" not in counter.chunks.young
