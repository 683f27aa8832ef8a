"""Suffix order by bucket-pointer refinement, as arrays."""

from __future__ import annotations

import numpy as np

from .arrays import U, loads

#: Bytes by which suffixes fall into their first buckets.
FIRST = 8


def bucket_pointers(raw: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The bucket pointer of every suffix in the order by ``depth`` bytes.

    ``raw`` holds texts one after the other, ``end[i]`` is where the text of byte i ends.
    Suffixes first fall into buckets by the q-gram of ``FIRST`` bytes; the pointer of a
    bucket is its place in suffix order. In each round, the suffixes of buckets that hold
    several are sorted by their own pointer and that of the suffix which starts as much
    further on as pointers reach; a part of a bucket gets its own place for a pointer,
    and the next round, which reaches twice as far, reads the pointers of this one.

    Of suffixes with ``depth`` bytes before their end, equal pointers mean equal bytes
    and a smaller pointer a smaller string; shorter ones stop where their text ends.
    """
    n = len(raw)
    room = end - np.arange(n)
    h = min(FIRST, depth)
    live = np.flatnonzero(room >= h)
    pointer = np.full(n, -1, np.int64)
    code = loads(raw, h)[live]
    order = np.argsort(code)
    live, code = live[order], code[order]
    place, many = _places(code)
    pointer[live] = place
    live = live[many]
    while h < depth and len(live):
        step = min(h, depth - h)
        h += step
        live = live[room[live] >= h]
        key = pointer[live].astype(np.uint64) << U(32) | pointer[live + step].astype(np.uint64)
        order = np.argsort(key)
        live, key = live[order], key[order]
        place, many = _places(key)
        own = (key >> U(32)).astype(np.int64)
        pointer[live] = own + place - _places(own)[0]
        live = live[many]
    return pointer


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each one's bucket begins, and whether it holds several."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    head = np.append(True, key[1:] != key[:-1])
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(key)))
    return np.repeat(begin, size), np.repeat(size > 1, size)
