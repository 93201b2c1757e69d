"""Texts of Arrow batches as numbered chunks, without a Python object per word.

The bytes of a batch's texts are cut at places that a caller marks; Arrow's
dictionary encoding numbers the chunks. Python then looks at each distinct chunk
of a batch once, however often it stands there, and arrays do the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; one longer text is looked at alone.
SLICE = 8 << 20
#: Space and \t to \r.
SPACES = " \t\n\x0b\x0c\r"


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | (raw - np.uint8(9) < 5)


def is_letter(raw: np.ndarray) -> np.ndarray:
    """Whether bytes are A-Z or a-z."""
    return (raw | np.uint8(32)) - np.uint8(97) < 26


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def is_one_of(raw: np.ndarray, chars: str) -> np.ndarray:
    table = bytes(int(chr(i) in chars and i < 128) for i in range(256))
    return np.frombuffer(raw.tobytes().translate(table), bool)


def slices(batch: pa.RecordBatch, column: int | str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and where each text begins; the last entry is where all end."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks, the number of each chunk's, and the chunks at which the texts begin.

    cut: whether a chunk begins at a byte; beginnings of texts are added.
    """
    cut[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(raw)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, at)


def words(texts: pa.Array, lower: bool = False, marks: str = "", spare: Sequence[bytes] = ()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (some may come twice), the number of each word's, and the words at which the texts begin.

    Words are runs of characters other than space and \\t to \\r. lower: with A-Z
    as a-z, unless the texts hold one of ``spare``, in any case. marks: ASCII
    marks that begin a word of their own after a letter A-Z or a-z.
    """
    raw, at = text_bytes(texts)
    if lower:
        small = lowered(raw)
        if not spare or not any(s in data for data in [small.tobytes()] for s in spare):
            raw = small
    space = is_space(raw)
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    if marks:
        cut[1:] |= is_one_of(raw, marks)[1:] & is_letter(raw)[:-1]
    # A chunk is a word and the white space before it; a text may end with a chunk of white space alone.
    found, code, bounds = chunks(raw, at, cut)
    found = [w.lstrip(SPACES) for w in found.to_pylist()]
    empty = np.array([not w for w in found], bool)
    if empty.any():
        real = ~empty[code]
        bounds = np.append(0, np.cumsum(real))[bounds]
        code = (np.cumsum(~empty) - 1)[code[real]]
        found = [w for w in found if w]
    return found, code, bounds


def gathered(lists: list[bytes], code: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values (integers of ``width`` bytes) of the coded lists, and where each list ends (from 0)."""
    kind = {4: np.uint32}[width]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists)) // width
    flat = pa.array(np.frombuffer(b"".join(lists), kind))
    all_lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), flat)
    ends = np.append(0, np.cumsum(lengths[code], dtype=np.int64))
    return all_lists.take(pa.array(code)).flatten().to_numpy(), ends


class Known:
    """What a task has learnt of the chunks it met, in two generations.

    When the younger one is full it becomes the older one, and what of that is
    asked for again comes back: frequent chunks stay known, and memory is bounded
    whatever the text. fill answers chunks that neither knows, in one call.
    """

    def __init__(self, fill: Callable[[list[str]], list], entries: int = 200_000, chars: int = 64):
        self.fill, self.entries, self.chars = fill, entries, chars
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def of(self, asked: list[str]) -> list:
        young, old = self.young, self.old
        new = set(asked).difference(young)
        again = new.intersection(old)
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        missing = list(new.difference(again))
        if missing:
            young.update(zip(missing, self.fill(missing), strict=True))
        out = list(map(young.__getitem__, asked))
        for w in missing:
            if len(w) > self.chars:
                del young[w]
        if len(young) > self.entries:
            self.young, self.old = {}, young
        return out
