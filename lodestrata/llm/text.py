"""Vectorised tokenising and rolling hashes over Arrow text columns.

A word is a maximal run of ASCII letters and digits and of bytes from 0x80 on,
after lower-casing. Its hash is a polynomial over random byte values modulo
2**64, taken from prefix sums, so a batch costs a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Text bytes handled at once; one longer document is handled alone and whole.
CHUNK = 2 << 20

_rng = np.random.default_rng(0x5EED)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_pow = np.ones(1, U)
_inv = np.ones(1, U)

#: The same words in RE2, on lower-cased text.
WORD_RE = r"[a-z0-9\x{80}-\x{10FFFF}]+"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, CHUNK + 1)
        for_base = np.full(m, U(BASE))
        for_base[0] = 1
        for_inv = np.full(m, U(BASE_INV))
        for_inv[0] = 1
        _pow, _inv = np.cumprod(for_base, dtype=U), np.cumprod(for_inv, dtype=U)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """hash, byte start and end of each word; offs[d]:offs[d+1] are document d's words."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offs: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words and the index of their first word."""
        return roll(self.hash, self.offs, k)


def roll(hashes: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = np.zeros(n - k + 1, U)
    for j in range(k):
        g = g * U(BASE) + hashes[j : n - k + 1 + j]
    ok = np.ones(n - k + 1, bool)
    for j in range(1, k):  # windows that cross a document's end
        edge = offs[1:-1] - j
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(g[at]), at


def words(texts: pa.Array, lower: bool = True) -> Words:
    data, offs = raw(pc.utf8_lower(pc.fill_null(texts, "")) if lower else texts)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(offs), np.int64))
    inside = WORD_BYTE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    pw, inv = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTE[data] * pw[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inv[start])
    return Words(h, start, end, np.searchsorted(start, offs))


def word_hash(text: str) -> np.ndarray:
    return words(pa.array([text])).hash


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about size text bytes each, cut between documents."""
    if not batch.num_rows:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lens) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def minimizers(hashes: np.ndarray, offs: np.ndarray, w: int) -> np.ndarray:
    """Indices of the rightmost minimum of every w consecutive hashes of a
    document; a document of fewer hashes gives its one minimum."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    picked = np.zeros(n, bool)
    lens = np.diff(offs)
    if n >= w:
        view = np.lib.stride_tricks.sliding_window_view(hashes, w)
        doc = np.repeat(np.arange(len(lens)), lens)
        ok = np.flatnonzero(doc[: n - w + 1] == doc[w - 1 :])
        for a in range(0, len(ok), 1 << 16):
            part = ok[a : a + (1 << 16)]
            picked[part + (w - 1 - np.argmin(view[part][:, ::-1], axis=1))] = True
    for d in np.flatnonzero((lens > 0) & (lens < w)):
        a, b = offs[d], offs[d + 1]
        picked[b - 1 - np.argmin(hashes[a:b][::-1])] = True
    return np.flatnonzero(picked)
