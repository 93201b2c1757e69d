"""SentencePiece encoding with source offsets, decoding, and token counts.

The normaliser is this module's own: it follows the compiled character map by
longest prefix and keeps, for each normalised character, the place in the
source that it came from. The normalised text is cut into pre-tokens at places
that no vocabulary piece crosses, so each pre-token's pieces are those it has
within the whole text. A task keeps the pre-tokens it met in a bounded cache; the
library encodes the others. Where the map is empty, as in the model of the
registered queries, normalising only marks spaces, and the bytes themselves are
cut; other models, and texts that hold the mark, go character by character.

Token counts look distinct pre-tokens up in two tiers: a compact broadcast table
of the frequent ones, which never changes, then the task's cache.

Defined results: a null or empty text has no pieces (begin and end ids still
stand where asked for). Texts are taken whole, however long; a pre-token too
long for the memo is encoded each time. Rows are judged one by one, so repeated
rows, ties and empty tables need no rule. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.spread import spread
from millrace.llm.common import more_fields
from millrace.llm.words import Known, chunks, gathered, is_letter, is_one_of, slices, text_bytes

SPACE = "▁"
class CharacterMap:
    """The compiled character map of a model: a double-array trie and its replacements."""

    def __init__(self, blob: bytes):
        self.units, self.text = np.zeros(0, np.uint32), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units, self.text = np.frombuffer(blob, "<u4", n // 4, 4), blob[4 + n :]
        self.leads = {b for b in range(256) if len(self.units) and self._step(0, b) is not None}

    def _step(self, node: int, byte: int) -> int | None:
        unit = int(self.units[node])
        child = node ^ (unit >> 10) << ((unit & 0x200) >> 6) ^ byte
        if child >= len(self.units):
            return None
        return child if int(self.units[child]) & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[at:], and what replaces it."""
        if not len(self.units) or data[at] not in self.leads:
            return None
        node, found = 0, None
        for k in range(at, len(data)):
            child = self._step(node, data[k])
            if child is None:
                break
            node = child
            unit = int(self.units[node])
            if unit >> 8 & 1:
                value = int(self.units[node ^ (unit >> 10) << ((unit & 0x200) >> 6)]) & 0x7FFFFFFF
                found = (k + 1 - at, self.text[value : self.text.index(b"\0", value)])
        return found


class Normaliser:
    """Text to its normalised form and the source byte at which each character begins.

    The alignment has one entry more than the normalised text has characters;
    the last is where the source ends.
    """

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not len(self.map.units) and not self.squeeze and self.escape

    def text(self, source: str) -> str:
        """The normalised form alone."""
        if not self.plain:
            return self.aligned(source)[0]
        return (SPACE if self.prefix and source else "") + source.replace(" ", SPACE)

    def aligned(self, source: str) -> tuple[str, np.ndarray]:
        data = source.encode("utf-8", "surrogatepass")
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            starts = np.flatnonzero((raw & 0xC0) != 0x80)
            parts = ([np.zeros(1, np.int64)] if self.prefix and source else []) + [starts, np.array([len(data)])]
            return self.text(source), np.concatenate(parts)
        out, at, k, after_space = [], [], 0, self.squeeze
        if self.prefix and data:
            out.append(SPACE if self.escape else " ")
            at.append(0)
            after_space = True and self.squeeze
        while k < len(data):
            mapped = self.map.longest(data, k)
            if mapped is None:
                n = 1 + next((i for i in range(3) if k + 1 + i >= len(data) or data[k + 1 + i] & 0xC0 != 0x80), 3)
                mapped = n, data[k : k + n]
            for c in mapped[1].decode("utf-8", "replace"):
                if c == " ":
                    if not (self.squeeze and after_space):
                        out.append(SPACE if self.escape else " ")
                        at.append(k)
                    after_space = True
                else:
                    out.append(c)
                    at.append(k)
                    after_space = False
            k += mapped[0]
        end = len(data)
        while self.squeeze and out and out[-1] in (SPACE, " "):
            out.pop()
            end = at.pop()
        return "".join(out), np.array([*at, end], np.int64)


class PieceModel:
    """A SentencePiece model on a worker; made from the bytes of its file."""

    def __init__(self, proto: bytes):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        self.normaliser = Normaliser(model.normalizer_spec)
        self.library = spm.SentencePieceProcessor(model_proto=proto)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.remove_extra_whitespaces = False
        self.core = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        normal = [p.piece for p in model.pieces if p.type in (1, 4, 5)]
        able = model.trainer_spec.model_type == model.trainer_spec.BPE and all(p.type != 4 for p in model.pieces)
        self.cut, self.marks, self.line = self._cutter(normal) if able else (None, "", False)
        self.chars = [0 if p.type == 6 else len(p.piece) for p in model.pieces]
        self.bytes_from = {i for i, p in enumerate(model.pieces) if p.type == 6}
        self.quick = self.normaliser.plain and self.normaliser.prefix and self.cut is not None

    @staticmethod
    def _cutter(normal: list[str]):
        """A function from normalised text to pre-tokens (or None), the marks and whether line ends cut.

        Merges never cross two neighbouring characters that no piece holds side
        by side. So a cut is safe before a run of spaces, around a line end that
        no piece holds, and between a letter or digit and those marks that no
        piece has after one.
        """
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            return None, "", False
        after = {b for p in normal for a, b in zip(p, p[1:], strict=False) if a.isalnum()}
        line = "" if any("\n" in p for p in normal) else "\n"
        marks = "".join(c for c in ".,!?*#$%&|;:" if c not in after)
        if not marks:
            return re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|\n").findall, "", bool(line)
        some = re.escape(marks)
        return re.compile(f"{SPACE}*[^{SPACE}{line}](?:[^{SPACE}{line}{some}]+|(?<![^\\W_])[{some}])*|{SPACE}+|\n").findall, marks, bool(line)

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pre-tokens of quick texts, with a space before each text, and their places as words.chunks has them."""
        some = pc.not_equal(pc.binary_length(texts), 0)
        raw, at = text_bytes(pc.if_else(some, pc.binary_join_element_wise(" ", texts, ""), texts))
        cut = raw == 32
        cut[1:] &= ~cut[:-1]
        if self.line:
            end = raw == 10
            cut |= end
            cut[1:] |= end[:-1]
        if self.marks:
            cut[1:] |= is_one_of(raw, self.marks)[1:] & (is_letter(raw) | (raw - np.uint8(48) < 10))[:-1]
        return chunks(raw, at, cut)

    def pre_tokens(self, normal: str) -> list[str]:
        if self.cut is None:
            return [normal] if normal else []
        return self.cut(normal)

    def count(self, pre_tokens: list[str]) -> list[int]:
        return [len(ids) for ids in self.core.encode(pre_tokens, num_threads=1)]

    def encode(self, pre_tokens: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids as 32-bit, and per id how many normalised characters it ends, as 32-bit.

        Of the bytes that stand for one character, the last ends it.
        """
        chars, made = self.chars, []
        for t, ids in zip(pre_tokens, self.core.encode(pre_tokens, num_threads=1), strict=True):
            ends = [chars[i] for i in ids] if self.bytes_from.isdisjoint(ids) else self._ends(t, ids)
            made.append((array("I", ids).tobytes(), array("I", ends).tobytes()))
        return made

    def encode_chunks(self, some: list[str]) -> list[tuple[bytes, bytes]]:
        """encode of chunks with plain spaces; per id how many bytes of the source it ends."""
        made = self.encode([c.replace(" ", SPACE) for c in some])
        for k, c in enumerate(some):
            if not c.isascii():
                size = np.cumsum([0, *(len(x.encode()) for x in c)])
                at = np.cumsum([0, *np.frombuffer(made[k][1], "<u4").tolist()])
                made[k] = made[k][0], np.diff(size[at]).astype("<u4").tobytes()
        return made

    def count_chunks(self, some: list[str]) -> list[int]:
        return self.count([c.replace(" ", SPACE) for c in some])

    def _ends(self, pre_token: str, ids: list[int]) -> list[int]:
        ends, at, k = [], 0, 0
        while k < len(ids):
            if ids[k] in self.bytes_from:
                n = len(pre_token[at].encode("utf-8", "surrogatepass"))
                ends += [0] * (n - 1) + [1]
                at, k = at + 1, k + n
            else:
                n = self.chars[ids[k]]
                ends.append(n)
                at, k = at + n, k + 1
        return ends


_MODELS: dict[tuple[int, int], PieceModel] = {}

def model_of(proto: bytes) -> PieceModel:
    """This worker's model; loaded once."""
    key = (len(proto), zlib.crc32(proto))
    if key not in _MODELS:
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


def _quick(model: PieceModel, texts: pa.Array) -> np.ndarray:
    """Which texts can be cut as bytes: those without the mark that stands for a space."""
    if not model.quick:
        return np.zeros(len(texts), bool)
    return ~pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)


class Encoder:
    """A task's encoder: a model, and what is known of its chunks and pre-tokens."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.chunks, self.pre_tokens = Known(model.encode_chunks, 100_000), Known(model.encode, 100_000)

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its ids, and the byte of the source at which each piece ends."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        quick = _quick(self.model, texts)
        found, code, at = self.model.chunks(texts.filter(pa.array(quick)))
        known = self.chunks.of(found.to_pylist())
        ids, ends = gathered([k[0] for k in known], code)
        sizes, _ = gathered([k[1] for k in known], code)
        upto, ends = np.append(0, np.cumsum(sizes, dtype=np.int64)), ends[at].tolist()
        bounds = iter(zip(ends[:-1], ends[1:], strict=True))
        made = []
        for text, q in zip(texts.to_pylist() if not quick.all() else [None] * len(texts), quick.tolist(), strict=True):
            if q:
                a, z = next(bounds)
                # The space put before the text is no byte of the source.
                made.append((ids[a:z], np.maximum(upto[a + 1 : z + 1] - upto[a] - 1, 0)))
            else:
                normal, source = self.model.normaliser.aligned(text)
                got = self.pre_tokens.of(self.model.pre_tokens(normal))
                chars = np.cumsum(np.frombuffer(b"".join([g[1] for g in got]), "<u4"), dtype=np.int64)
                made.append((np.frombuffer(b"".join([g[0] for g in got]), "<u4"), source[chars]))
        return made


#: What encode_documents can return besides the id.
ENCODED = {
    "ids": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "ends_crc32": "long",
    "covered": "long",
}


def encode_documents(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "ends"), bos: bool = True, eos: bool = True) -> DataFrame:
    """id and the outputs asked for, one row per input row; no shuffle.

    ids: with begin and end where asked. ends: for every id without begin and
    end, the byte of the source after its last; a piece begins where the one
    before it ends, and of the bytes standing for one character only the last
    moves on. decoded: the library's decode(ids). covered: bytes that the pieces
    span. The digests are of these values, as 32-bit little-endian integers or UTF-8.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(proto)
    narrow = spread(docs.select(F.col(id_col), F.col(text_col).alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto = shared.value
        model = model_of(proto)
        head = struct.pack("<I", model.bos) if bos else b""
        tail = struct.pack("<I", model.eos) if eos else b""
        decode = {"decoded", "decoded_sha256"} & set(outputs)
        kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}
        encoder = Encoder(model)
        for whole in batches:
            for b in slices(whole, 1):
                made: dict[str, list] = {o: [] for o in outputs}
                for own, ends in encoder.encode(b.column(1)):
                    ids = head + own.tobytes() + tail
                    decoded = model.library.decode(np.frombuffer(ids, "<u4").tolist()) if decode else ""
                    for o in outputs:
                        made[o].append(
                            np.frombuffer(ids, "<i4") if o == "ids"
                            else ends.astype("<i4") if o == "ends"
                            else decoded if o == "decoded"
                            else len(ids) // 4 if o == "n_tokens"
                            else hashlib.sha256(ids).hexdigest() if o == "ids_sha256"
                            else hashlib.sha256(decoded.encode()).hexdigest() if o == "decoded_sha256"
                            else zlib.crc32(ends.astype("<u4").tobytes()) if o == "ends_crc32"
                            else int(ends[-1]) if len(ends) else 0
                        )
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(made[o], kinds[ENCODED[o]]) for o in outputs]], names=[id_col, *outputs])

    schema = more_fields(docs.select(F.col(id_col)).schema, ", ".join(f"{o} {ENCODED[o]}" for o in outputs))
    return narrow.mapInArrow(run, schema)


def decode_documents(df: DataFrame, proto: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text: the library's decode of each row's ids; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model_of(shared.value).library
        for b in batches:
            text = [library.decode(x or []) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col).alias("_ids")).mapInArrow(run, df.select(id_col).schema.add("text", "string"))


# Token counts ---------------------------------------------------------------


class Counter:
    """A task's token counts: the broadcast tier, then a cache, then the library."""

    def __init__(self, model: PieceModel, table: tuple[pa.Array, np.ndarray] = (pa.array([], pa.string()), np.zeros(0, np.int64))):
        self.model, (self.frequent, self.lengths) = model, table
        self.chunks, self.pre_tokens = Known(model.count_chunks, 200_000), Known(model.count, 100_000)

    def of_chunks(self, found: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(found, value_set=self.frequent), -1).to_numpy(zero_copy_only=False)
        out, missing = np.zeros(len(found), np.int64), np.flatnonzero(at < 0)
        out[at >= 0] = self.lengths[at[at >= 0]]
        if len(missing):
            out[missing] = self.chunks.of(found.take(pa.array(missing)).to_pylist())
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        quick = _quick(self.model, texts)
        found, code, at = self.model.chunks(texts.filter(pa.array(quick)))
        out = np.zeros(len(texts), np.int64)
        out[quick] = np.diff(np.append(0, np.cumsum(self.of_chunks(found)[code]))[at])
        for k in np.flatnonzero(~quick).tolist():
            out[k] = sum(self.pre_tokens.of(self.model.pre_tokens(self.model.normaliser.text(texts[k].as_py()))))
        return out


def frequent_lengths(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text", share: int = 16, entries: int = 32_768, of_task: int = 4096) -> tuple[list[str], list[int]]:
    """The first tier: frequent pre-tokens and their token counts, at most ``entries``.

    One row in ``share``, by a hash, is counted inside the task that reads it; a
    task sends its ``of_task`` most frequent pre-tokens, and only these few rows
    are summed. The table saves work, and no count depends on it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = model_of(shared.value), {}
        for whole in batches:
            for b in slices(whole, 0):
                texts = pc.fill_null(b.column(0).cast(pa.string()), "")
                found, code, _ = model.chunks(texts.filter(pa.array(_quick(model, texts))))
                for t, n in zip(found.to_pylist(), np.bincount(code, minlength=len(found)).tolist(), strict=True):
                    seen[t] = seen.get(t, 0) + n
                if len(seen) > 50 * of_task:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: 10 * of_task])
        top = [(t, n) for t, n in sorted(seen.items(), key=lambda x: -x[1])[:of_task] if len(t) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array(model.count_chunks([t for t, _ in top]), pa.int64()), pa.array([n for _, n in top], pa.int64())], names=["t", "n", "seen"])

    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(share)) == 0).select(F.col(text_col))
    rows = spread(some).mapInArrow(run, "t string, n long, seen long").groupBy("t", "n").agg(F.sum("seen").alias("seen"))
    got = rows.orderBy(F.desc("seen"), "t").limit(entries).collect()
    return [r["t"] for r in got], [r["n"] for r in got]


def count_tokens(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, table: tuple[list[str], list[int]] | None = None) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit per row, without begin and end; no pre-token is shuffled.

    table: what frequent_lengths gives; made from docs where absent.
    """
    spark = docs.sparkSession
    known, lengths = frequent_lengths(docs, proto, id_col, text_col) if table is None else table
    shared = spark.sparkContext.broadcast((proto, pa.array(known, pa.string()), np.array(lengths, np.int64)))
    narrow = spread(docs.select(F.col(id_col), F.col(text_col).alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, known, lengths = shared.value
        counter = Counter(model_of(proto), (known, lengths))
        for whole in batches:
            for b in slices(whole, 1):
                n = counter.count(b.column(1))
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(run, docs.select(F.col(id_col)).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean"))
