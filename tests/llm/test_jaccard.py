"""Components of the Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from fieldspan.llm import jaccard
from fieldspan.llm.repeats import unpacked

from .corpus import frame, texts
from .test_repeats import morse


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                if x != y:
                    label = {i: min(x, y) if c in (x, y) else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def family(seed, n=90):
    """Near copies of one text, of which some link only through others."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = "x" + str(r.randrange(1000))
        out.append(" ".join(w))
    return out


ALL, SOME = ((float("inf"), 1.0),), ((130, 1.0), (145, 0.6), (float("inf"), 0.4))


def grown(seed):
    """Texts of neighbouring sizes, which link across the sizes where shares change."""
    r = random.Random(seed)
    base = ["".join(r.choice("ijklmnop") for _ in range(5)) for _ in range(175)]
    return [" ".join(base[:n]) for n in range(115, 175, 6)]


@pytest.mark.parametrize(("n", "percent", "shares"), [(4, 85, jaccard.SHARES), (4, 85, SOME), (4, 85, ((20, 1.0), (float("inf"), 0.1))), (3, 60, ALL)])
def test_components(spark, monkeypatch, n, percent, shares):
    for name, value in (("PART", 20), ("BLOCK", 8), ("SHARES", shares)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(4)
    values = texts(10, 60) + family(5) + grown(6) + ["A b C", "a B c", "a b c", "a b", "A B"]
    r.shuffle(values)
    want = brute([(i * 3 + 1, t) for i, t in enumerate(values)], n, percent)
    rows = jaccard.near_groups(frame(spark, values).repartition(3), n, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == want
    assert len(rows) == len(values)


def test_edges(spark):
    df = frame(spark, ["a"])
    assert jaccard.near_groups(df.filter("false")).count() == 0
    rows = [(None, "a b c d e", 1), (4, "a b c d e", 2), (4, "a b c d e", 3), (2, "A B c d e", 4), (9, None, 5), (8, "  ", 6)]
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    want = [(None, 2, None), (4, 2, 2), (4, 2, 2), (2, 2, 2), (9, 0, 9), (8, 0, 8)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_alike_modulo_powers_of_two(spark, n):
    a, b = morse(n)
    rest = " ".join(f"w{i}" for i in range(12))
    values = [f"{a} {rest}", f"{b} {rest}", f"k {a} l", f"k {b} l"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(frame(spark, values)).collect()}
    assert got == brute([(i * 3 + 1, t) for i, t in enumerate(values)], 4, 85)
    assert len({c for _, c in got.values()}) == 4


def test_long_paths(spark):
    """Components of chains much longer than the steps of a pass."""
    r = random.Random(7)
    ids = list(range(120))
    r.shuffle(ids)
    pairs = list(zip(ids[:70], ids[1:70])) + list(zip(ids[70:119], ids[71:119]))
    nodes = spark.createDataFrame([(i,) for i in ids], "x long")
    got = {x.x: x.c for x in jaccard.components(nodes, spark.createDataFrame(pairs, "u long, v long"), 1).collect()}
    assert got == {i: min(part) for part in (ids[:70], ids[70:119], ids[119:]) for i in part}


def test_hot_shingles_are_posted_twice():
    """What a bucket gets of a passage that all texts hold, and the counts it gives."""
    hot = "one passage that every text of the corpus holds somewhere in it"
    values = [f"a{i} b{i} c{i} d{i} {hot} e{i % 7} f{i % 7} g{i % 7} h{i % 7}" for i in range(40)] * 2
    batch = pa.record_batch([pa.array(range(80), pa.int64()), pa.array(values)], names=["rep_id", "rep_text"])
    post = jaccard._class_postings(4, 3, 85, ALL)
    for parts in ([batch], [batch.slice(0, 30), batch.slice(30)]):
        # each part is a task of its own
        out = pa.Table.from_batches([b for part in parts for b in post(iter([part]))])
        blobs = [x for x in out["postings"].to_pylist() if x]
        assert np.unique(unpacked(blobs, ("key", "doc", "size"))["key"], return_counts=True)[1].max() <= 2 * len(parts)
        tables = [jaccard._shared_counts(out.filter(pa.compute.equal(out["bucket"], b))).to_pylist() for b in range(3)]
        got, least = {}, {}
        for r in (r for t in tables for r in t):
            got[r["one"]] = got.get(r["one"], 0) + (r["shared"] or 0)
            if r["known"] is not None:
                least[r["one"]] = min(r["known"], least.get(r["one"], r["known"]))
        owner, h = jaccard.shingles([v.encode() for v in values[:40]], 4)
        _, local, many = np.unique(h, return_inverse=True, return_counts=True)
        want = np.bincount(owner, many[local] > 1).astype(int).tolist()
        bound = [got.get(i, 0) + least[i] for i in jaccard._sums(40, owner, h)[1].tolist()]
        assert all(b >= w for b, w in zip(bound, want))
        assert bound == want or len(parts) > 1


def test_different_texts_under_one_id(spark):
    """An id joins what its texts link with; its blank texts stay alone."""
    r = random.Random(9)
    a, b, c = (" ".join(str(r.random()) for _ in range(60)) for _ in range(3))
    rows = [(9, a), (4, a + " end"), (4, b), (4, b), (4, " "), (7, b + " end"), (5, c), (None, a), (None, None), (5, c), (3, c + " end"), (8, a + " x y"), (2, "")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, c int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.near_groups(df.repartition(3)).collect())
    size = lambda t: max(len((t or "").split()) - 3, 0)
    want = {9: 4, 4: 4, 7: 4, 8: 4, 5: 3, 3: 3, 2: 2, None: -1}
    assert got == sorted((i or -1, size(t), want[i]) for i, t in rows)
