"""Whole-batch text coding in numpy: words, word hashes and n-gram hashes of many texts at once.

All functions work on one UTF-8 buffer that holds the texts of a batch end to
end, with their byte offsets, so Python never loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Bytes of a word for each word rule: everything but white space, and letters, digits and non-ASCII.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
ALNUM_WORDS[0x41:0x5B] = False  # texts are lower-cased first

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Bytes of text coded at a time; one longer text is coded alone.
CHUNK_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the input changes every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``limit`` bytes of text (or one row)."""
    col = batch.column(batch.schema.get_field_index(text))
    _, offs = buffer_of(col)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words of the texts of one chunk.

    ``start``, ``length``: bytes of each word; ``offs``: first word of each text
    (one more entry at the end); ``doc``: text of each word; ``buf``: the
    (lower-cased) bytes.
    """

    def __init__(self, col: pa.Array, inside: np.ndarray, lower: bool):
        buf, offs = buffer_of(col)
        self.buf = _LOWER[buf] if lower else buf
        n = len(self.buf)
        flag = np.empty(n + 1, dtype=bool)
        flag[:n] = inside[self.buf]
        flag[n] = False
        first = flag[:n].copy()
        first[1:] &= ~flag[:n][:-1]
        last = flag[:n].copy()
        last[:-1] &= ~flag[1:n]
        cut = offs[(offs > 0) & (offs < n)]  # texts lie end to end: a word ends with its text
        first[cut] = flag[cut]
        last[cut - 1] = flag[cut - 1]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        self.offs = np.searchsorted(self.start, offs, side="left")
        self.counts = np.diff(self.offs)
        self._doc = None

    @property
    def doc(self) -> np.ndarray:
        if self._doc is None:
            self._doc = np.repeat(np.arange(len(self.counts)), self.counts)
        return self._doc

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, eight bytes at a time."""
        return hash_spans(self.buf, self.start, self.length)

    def word(self, i: int) -> bytes:
        s = self.start[i]
        return self.buf[s:s + self.length[i]].tobytes()

    def span(self, i: int, j: int) -> tuple[bytes, ...]:
        return tuple(self.word(x) for x in range(i, j))

    def room(self, k: int) -> np.ndarray:
        """Starts of the windows of ``k`` words that end within their text."""
        end = np.repeat(self.offs[1:], self.counts)
        return np.flatnonzero(np.arange(len(end)) + k <= end)


def hash_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of byte spans of one buffer, eight bytes at a time."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[:len(buf)] = buf
    view = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = mix(length.astype(np.uint64) * _GOLD + np.uint64(1))
    h = mix(h ^ (view[start] & _KEEP[np.minimum(length, 8)]))
    more = np.flatnonzero(length > 8)
    j = 8
    while len(more):
        left = length[more] - j
        h[more] = mix((h[more] * _GOLD) ^ (view[start[more] + j] & _KEEP[np.minimum(left, 8)]))
        more = more[left > 8]
        j += 8
    return h


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes (len(h) - k + 1 of them, ends of texts ignored)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    p = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j:j + n] * p
            p *= np.uint64(0xD6E8FEB86659FD93)
    return mix(out)
