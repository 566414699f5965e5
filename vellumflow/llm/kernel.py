"""Vectorised text kernels on Arrow buffers: words, word hashes and word prefixes.

The functions work on the UTF-8 bytes of a whole Arrow string array at once, so that no Python
object is made for a document or a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_PRIME, _BASIS = U64(0x100000001B3), U64(0xCBF29CE484222325)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Bytes of words: ASCII letters, digits, underscore and all bytes of non-ASCII characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
#: Words are hashed byte by byte up to here; what follows is hashed at once.
LONG = 32
#: Bytes handled at once; a longer document is handled alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes together, or of one document."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and for each document the index of its first word (n + 1)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = IS_WORD[buf]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    full = offs[1:] > offs[:-1]  # a border between documents ends a word
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first], end[last] = w[first], w[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1 - s, np.searchsorted(s, offs)


def hash_words(buf: np.ndarray, s: np.ndarray, lens: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """64-bit hashes of the words; for each k in ``prefixes`` the words of over k bytes and the hashes of their first k."""
    h = np.full(len(s), _BASIS)
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    act = np.arange(len(s))
    for k in range(LONG):
        longer = lens[act] > k
        if not longer.all():
            act = act[longer]
        if k in prefixes:
            out[k] = act, mix(h[act] + U64(k))
        if not len(act):
            for p in prefixes:
                out.setdefault(p, (act, h[act]))
            break
        h[act] = (h[act] ^ buf[s[act] + k]) * _PRIME
    for i in np.flatnonzero(lens > LONG):
        h[i] ^= U64(xxhash.xxh64_intdigest(buf[s[i] + LONG : s[i] + lens[i]].tobytes()))
    return mix(h), out
