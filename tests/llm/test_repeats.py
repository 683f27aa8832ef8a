"""Byte-string and word-window dedup against plain Python over all windows."""

import hashlib

import numpy as np
import pytest
from fieldspan.llm import repeats, substrings
from fieldspan.llm.suffixes import bucket_pointers

from .corpus import frame, texts


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(bytes(gone).startswith(b"\1") if j == 0 else gone[j] > gone[j - 1] for j in range(len(b))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def brute_words(rows, n):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), i)
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize(("length", "q"), [(100, 25), (20, 5)])
def test_bytes(spark, length, q):
    values = texts(5, 80)
    df = frame(spark, values).repartition(5)
    want = brute_bytes([(i * 3 + 1, t) for i, t in enumerate(values)], length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.dedup_substrings(df, length, q).collect()}
    assert got == want
    assert sum(x[1] > 0 for x in want.values()) > 20


@pytest.mark.parametrize(("n", "q"), [(13, 5), (4, 2)])
def test_words(spark, n, q):
    values = texts(6, 80)
    df = frame(spark, values).repartition(5)
    want = brute_words([(i * 3 + 1, t) for i, t in enumerate(values)], n)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substrings.dedup_ngrams(df, n, q).collect()}
    assert got == want
    assert sum(x[1] > 0 for x in want.values()) > 10


@pytest.mark.parametrize(("hot", "few"), [(3, 1), (0, 10**6)])
def test_hot_grams(spark, monkeypatch, hot, few):
    """Q-grams in more ranges than a bucket keeps: their windows go one by one."""
    monkeypatch.setattr(repeats, "HOT", hot)
    posted = repeats._range_postings
    monkeypatch.setattr(repeats, "_range_postings", lambda shape, buckets, _: posted(shape, buckets, few))
    values = texts(8, 60) + [f"{i} {i * 7} a line that very many of the documents hold between words of their own {i * 3} x{i}" for i in range(40)]
    df = frame(spark, values).repartition(5)
    rows = [(i * 3 + 1, t) for i, t in enumerate(values)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.dedup_substrings(df, 40, 10).collect()}
    assert got == brute_bytes(rows, 40)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substrings.dedup_ngrams(df, 6, 3).collect()}
    assert got == brute_words(rows, 6)


@pytest.mark.parametrize("depth", [5, 8, 20, 100])
def test_pointers_order_suffixes(depth):
    blobs = [t.encode() for t in texts(9, 40) if t] + [b"", b"ab" * 300, b"a" * 500, b"ab" * 290 + b"c", bytes(range(256)) * 2]
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    end = np.repeat(np.cumsum([len(b) for b in blobs]), [len(b) for b in blobs])
    pointer = bucket_pointers(raw, end, depth)
    at = [i for i in range(len(raw)) if i + depth <= end[i]]
    order = sorted(at, key=lambda i: pointer[i])
    data = raw.tobytes()
    assert all(pointer[i] >= 0 for i in at) and len(set(at)) > 1000
    for i, j in zip(order, order[1:]):
        a, b = data[i : i + depth], data[j : j + depth]
        assert a == b if pointer[i] == pointer[j] else a < b


def morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_alike_modulo_powers_of_two(spark, n):
    """Words that polynomials modulo 2**64 take for one differ here."""
    a, b = morse(n)
    rest = " ".join(f"w{i}" for i in range(12))
    values = [f"{a} {rest}", f"{b} {rest}", a + b + a, b + a + b]
    df = frame(spark, values)
    rows = [(i * 3 + 1, t) for i, t in enumerate(values)]
    assert {r.doc_id: r.n_removed for r in substrings.dedup_ngrams(df).collect()} == {i: x[1] for i, x in brute_words(rows, 13).items()}
    assert {r.doc_id: r.n_removed for r in substrings.dedup_substrings(df).collect()} == {i: x[1] for i, x in brute_bytes(rows, 100).items()}


def test_very_long_words(spark):
    """One word longer than every step, repeated, among words of a usual length."""
    long = "".join(chr(97 + i * i % 23) for i in range(700_000))
    values = [f"{long} " + " ".join(f"w{i}" for i in range(12)), "x", f"y {long} " + " ".join(f"w{i}" for i in range(12))]
    got = {r.doc_id: r.n_removed for r in substrings.dedup_ngrams(frame(spark, values)).collect()}
    assert got == {1: 0, 4: 0, 7: 13}


def test_small_steps(spark, monkeypatch):
    """Slices, packs and steps far smaller than the texts change nothing."""
    values = [t for t in texts(7, 30)]
    for by_word, length, q in ((False, 100, 25), (True, 13, 5)):
        shape = repeats.Shape(length, q, by_word, True)
        blobs = [(t or "").encode() for t in values]
        found = []
        for step in (1 << 19, 700):
            monkeypatch.setattr(repeats, "STEP", step)
            sym, start, end = repeats.symbols(shape, blobs)
            rows = set()
            for key, _, owner, at, size in repeats.ranges(shape, sym, start, end):
                rows |= {(int(k), int(o), int(a) + j) for k, o, a, s in zip(key, owner, at, size) for j in range(s)}
            found.append(rows)
        assert found[0] == found[1]
        assert len(found[0]) == int(np.maximum(end - start - length + 1, 0).sum())


def test_edges(spark):
    df = frame(spark, ["a"]).filter("false")
    assert substrings.dedup_substrings(df).count() == 0 and substrings.dedup_ngrams(df).count() == 0
    long = "word " * 60
    rows = [(None, long, 1), (5, long, 2), (5, long, 3), (7, long, 4), (8, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark long")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup_ngrams(df).collect()) == [(0, 0), (5, 0), (5, 0), (7, 60), (8, 0)]
    assert substrings.dedup_substrings(df).count() == 5
