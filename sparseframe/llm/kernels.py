"""Vectorised text kernels over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash

U = np.uint64
_CHUNK = 1 << 18
#: Longer words are hashed one at a time.
_LONG = 1 << 12
#: Two hashes: their multipliers, the bytes' values, and the multipliers' powers and inverse powers as far as they were needed.
_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_RND = [np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=seed) for b in range(256)], dtype=U) for seed in (7, 11)]
_POWERS = [(np.ones(1, dtype=U), np.ones(1, dtype=U)) for _ in _MUL]

#: Bytes of words: everything but ASCII white space.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of alphanumeric words: ASCII letters and digits, and all of multi-byte characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets; nulls are empty."""
    if col.null_count:
        col = pa.compute.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one entry more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = member[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of a multiplier and of its inverse."""
    if len(_POWERS[which][0]) < n:
        m, out = 1 << int(n - 1).bit_length(), []
        for f in (_MUL[which], pow(_MUL[which], -1, 1 << 64)):
            p = np.full(m, U(f), dtype=U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _POWERS[which] = tuple(out)
    return _POWERS[which]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The members of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the spans' bytes, the same wherever a span stands; `which`: one of two independent ones."""
    out = np.empty(len(starts), dtype=U)
    rnd = _RND[which]
    i, total = 0, len(starts)
    while i < total:
        base = starts[i]
        j = max(int(np.searchsorted(ends, base + _CHUNK, "right")), i + 1)
        if ends[i] - base > _LONG:
            out[i] = xxhash.xxh3_64_intdigest(data[base : ends[i]].tobytes(), seed=which)
            i += 1
            continue
        over = np.flatnonzero(ends[i:j] - starts[i:j] > _LONG)
        if len(over):
            j = i + int(over[0])
        top = ends[j - 1]
        m = int(top - base)
        power, inverse = powers(m + 1, which)
        acc = np.zeros(m + 1, dtype=U)
        np.cumsum(rnd[data[base:top]] * power[:m], dtype=U, out=acc[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((acc[e] - acc[s]) * inverse[s] + (e - s).astype(U))
        i = j
    return out


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of k-word shingles; of the whole sequence where it has fewer words; none without words."""
    n = len(h)
    if n >= k:
        s = h[: n - k + 1].copy()
        for d in range(1, k):
            s = mix(s * U(0x165667B19E3779F9) + h[d : n - k + 1 + d])
    else:
        s = h[:0]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        m = b - a
        if m >= k:
            v = np.sort(s[a : b - k + 1])
            if len(v) > 1:
                v = v[np.concatenate(([True], v[1:] != v[:-1]))]
            out.append(v)
        elif m:
            x = h[a : a + 1]
            for d in range(a + 1, b):
                x = mix(x * U(0x165667B19E3779F9) + h[d : d + 1])
            out.append(mix(x + U(m)))
        else:
            out.append(h[:0])
    return out
