"""Vectorised hashing of text bytes in Arrow batches (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Texts are hashed in blocks of about this many bytes, which bounds a worker's memory.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if len(column) == 0 or bufs[2] is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return off - off[0], np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]]


def doc_blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each (a longer document is alone in its range)."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                      for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


class RangeHash:
    """64-bit polynomial hashes of any short byte ranges of one buffer (long ones collide by their pattern: see ``token_hashes``)."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Longer tokens are hashed byte by byte. Sums modulo 2**64 collide by pattern (Thue-Morse words, whatever the base), but
#: not within so few bytes: differences of at most 255 cannot make up 64 factors of two there.
SHORT = 48


def token_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    out = RangeHash(data)(start, end)
    long = np.flatnonzero(end - start > SHORT)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        own = [blake2b(view[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(own), "<u8")
    return out


def tokens(data: np.ndarray, off: np.ndarray, classes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every token: a run of bytes of one class within one document; class 0 separates.

    ``off`` are the documents' offsets in ``data`` (whole documents).
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = classes[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    real = kind[start] != 0
    start, end = start[real], end[real]
    return token_hashes(_LOWER[data] if lower else data, start, end), np.searchsorted(off, start, "right") - 1


#: Token classes: words are runs of anything but ASCII white space.
WORDS = (~_WS).astype(np.uint8)
#: Words and runs of punctuation apart (bytes from 128 on count as letters).
WORDS_AND_MARKS = WORDS.copy()
for _b in range(128):
    if not _WS[_b] and not chr(_b).isalnum():
        WORDS_AND_MARKS[_b] = 2


def pieces_at_white_space(text: bytes, limit: int) -> Iterator[bytes]:
    """``text`` in pieces of about ``limit`` bytes, cut only at ASCII white space."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(c, at, at + limit) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, at + limit)) >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


def long_tokens(data: np.ndarray, off: np.ndarray, classes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``tokens``, for a block that may hold one document far beyond the block size."""
    if len(data) <= 2 * BLOCK or len(off) > 2:
        return tokens(data, off, classes, lower)
    parts = [np.frombuffer(p, np.uint8) for p in pieces_at_white_space(data.tobytes(), BLOCK)]
    hashes = np.concatenate([tokens(p, np.array([0, len(p)]), classes, lower)[0] for p in parts])
    return hashes, np.zeros(len(hashes), np.int64)
