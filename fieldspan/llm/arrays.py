"""Hashes over texts as NumPy arrays, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

U = np.uint64
#: Bytes of text, or symbols, that a task holds as arrays at once.
STEP = 1 << 19
#: Symbols hashed at a time: what stays in a core's cache.
BLOCK = 1 << 15
#: Odd multipliers, and bases of the polynomials modulo PRIME.
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
PRIME = (1 << 61) - 1
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOW31, _LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    t = x >> U(32)
    x ^= t
    x *= U(0xD6E8FEB86659FD93)
    np.right_shift(x, U(32), out=t)
    x ^= t
    x *= U(0xD6E8FEB86659FD93)
    np.right_shift(x, U(32), out=t)
    x ^= t
    return x


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift-multiply)."""
    return _mix(x.copy())


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, or PRIME and a little more; ``x`` is spent."""
    t = x >> U(61)
    x &= U(PRIME)
    x += t
    return x


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo PRIME but for a fold, below 2**63 + 2**33; x is folded, c below PRIME."""
    high, low = U(c >> 31), U(c & 0x7FFFFFFF)
    x1, x0 = x >> U(31), x & _LOW31
    mid = x1 * low
    mid += x0 * high
    x1 *= high + high
    x0 *= low
    x1 += x0
    np.right_shift(mid, U(30), out=x0)
    x1 += x0
    mid &= _LOW30
    mid <<= U(31)
    x1 += mid
    return x1


def grams(sym: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash modulo 2**61 - 1 of the ``n`` symbols from each position on.

    By doubling: the hash of 2h symbols joins those of h symbols here and h further on.
    Value i is right where i + n <= len(sym); there are len(sym) - n + 1 values.
    """
    if len(sym) > BLOCK + n:
        return np.concatenate([grams(sym[lo : lo + BLOCK + n - 1], n, base) for lo in range(0, len(sym) - n + 1, BLOCK)])
    b = int(base) % PRIME
    done, out, h, step = 0, None, 1, _folded(sym.copy())
    k = n
    while k:
        if k & 1:
            if out is None:
                out, done = step, h
            else:
                m = min(len(out), len(step) - done)
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = _times(out[:m], pow(b, h, PRIME))
                out += step[done : done + m]
                out = _folded(out)
                done += h
        k >>= 1
        if k:
            if len(step) <= h:
                return np.zeros(0, np.uint64)
            further = step[h:]
            step = _times(step[:-h], pow(b, h, PRIME))
            step += further
            step = _folded(step)
            h *= 2
    out = out[: max(len(sym) - n + 1, 0)]
    return np.where(out >= U(PRIME), out - U(PRIME), out)


def loads(raw: np.ndarray, n: int = 8) -> np.ndarray:
    """The ``n`` bytes (8 at most) from each position on as one number, first byte highest."""
    count = len(raw) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    room = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(count, ">u8", room, 0, (1,)).astype(np.uint64) >> U(8 * (8 - n))


def byte_ids(raw: np.ndarray, n: int, have: np.ndarray | None = None, h: int = 0, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Identifiers of the ``n`` bytes from each position on, by doubling.

    Up to 8 bytes are their own identifier, mixed; 2h bytes take theirs from those of h
    bytes here and h further on, mixed at every step, so that no structure of the text
    survives as it does in polynomials modulo 2**64. ``have``: those of h bytes, if known.
    """
    if len(raw) > BLOCK + n:
        parts = range(0, len(raw) - n + 1, BLOCK)
        return np.concatenate([byte_ids(raw[lo : lo + BLOCK + n - 1], n, None if have is None else have[lo : lo + BLOCK + n - h], h, base) for lo in parts])
    if have is None:
        h = min(n, 8)
        have = _mix(loads(raw, h))
    while h < n:
        step = min(h, n - h)
        further = have[step:]
        have = have[:-step] * base
        have += further
        have = _mix(have)
        h += step
    return have


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of the ``n`` values from each position on."""
    if len(x) < n:
        return x[:0]
    h = 1
    while 2 * h <= n:
        x = np.minimum(x[:-h], x[h:])
        h *= 2
    return x if h == n else np.minimum(x[: len(x) - (n - h)], x[n - h :])


def words(raw: np.ndarray, spaces: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array that ends with a space."""
    is_space = spaces[raw]
    edge = np.flatnonzero(is_space[1:] != is_space[:-1]) + 1
    if len(raw) and not is_space[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes and its length.

    Up to 16 bytes the first and the last eight say all; longer words are hashed whole
    by xxHash. Words of one length up to 8 bytes never share a hash.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    room = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", room, 0, (1,))
    size = ends - starts
    out = mixed(mixed(eight[starts].astype(np.uint64) & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * BASES[0])
    more = np.flatnonzero(size > 8)
    if len(more):
        out[more] = mixed(out[more] * BASES[1] + mixed(eight[ends[more] - 8].astype(np.uint64)))
        data = memoryview(raw)
        for i in more[size[more] > 16].tolist():
            out[i] = xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def joined(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each ended by ``sep``, and where each begins."""
    raw = np.frombuffer(sep.join([*texts, b""]), np.uint8)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(sep) for t in texts], out=begin[1:])
    return raw, begin


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``most`` in all, or of one row."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            out.append((lo, i))
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        out.append((lo, len(sizes)))
    return out


def small(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about STEP bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for lo, hi in slices(sizes, STEP):
            yield batch.slice(lo, hi - lo)
