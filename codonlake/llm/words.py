"""Hashes of the words of whole texts, made on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mix

#: Words of more bytes are hashed one by one.
LONG = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text's words begin (and the last one's end).

    A-Z are lower-cased; words are what stands between space and \\x09-\\x0D. A null text has none.
    """
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(at, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(at[-1] - at[0])
    raw = np.zeros(size + 8, dtype=np.uint8)
    if size:
        raw[:size] = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    raw[:size] += ((raw[:size] - 65) < 26).view(np.uint8) << 5
    inside = ~((raw[:size] == 32) | ((raw[:size] - 9) < 5))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, at)
    lens = end - start
    block = np.ndarray(shape=(size + 1,), dtype="<u8", buffer=raw, strides=(1,))
    h = mix((block[start] & _MASK[np.minimum(lens, 8)]) + lens.astype(np.uint64) * _A)
    rest = np.flatnonzero((lens > 8) & (lens <= LONG))
    k = 8
    while len(rest):
        h[rest] = mix(h[rest] * _A + (block[start[rest] + k] & _MASK[np.minimum(lens[rest] - k, 8)]))
        k += 8
        rest = rest[lens[rest] > k]
    for i in np.flatnonzero(lens > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return h, first


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the n-word shingles of each whole text.

    With fewer than n words the whole sequence is one shingle; without words there is none.
    """
    h, first = hashed_words(texts)
    z = h[: max(0, len(h) - n + 1)]
    for k in range(1, n):
        z = mix(z * _A + h[k : len(h) - n + 1 + k]) if len(z) else z
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(z[a : b - n + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            s = np.array([b - a], dtype=np.uint64)
            for x in h[a:b]:
                s = mix(s * _A + x)
            out.append(s)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
