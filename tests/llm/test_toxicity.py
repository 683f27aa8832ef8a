"""Held-out accuracy, the pair term, and odd inputs."""

import random

import numpy as np
from fieldspan.llm import toxicity as tox


def labelled(seed, n=600):
    """Toxic if a slur stem stands in the text, or 'group' together with 'attack'."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(r.choice("abdehiknorst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(20, 60))]
        kind = r.randrange(6)
        w += [["grumfle" + r.choice(["", "s", "d"])], ["group", "attack"], ["group"], ["attack"], [], []][kind]
        r.shuffle(w)
        out.append((i + seed * 10_000, " ".join(w).title() if r.random() < 0.2 else " ".join(w), int(kind < 2)))
    return out


def test_held_out(spark):
    kinds = "doc_id long, text string, toxic int"
    model = tox.train(spark.createDataFrame(labelled(1, 1500), kinds))
    rows = tox.score(spark.createDataFrame(labelled(2), kinds), model).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in rows) / len(rows)
    assert right > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_pairs_say_more_than_sums(spark):
    """Labels by an insult beside a group's name: an additive model of the same terms and
    rows misses what the factorization machine finds."""

    def rows(seed, n):
        r = random.Random(seed)
        out = []
        for i in range(n):
            a, b = r.random() < 0.4, r.random() < 0.4
            w = ["".join(r.choice("abdehiknorst") for _ in range(5)) for _ in range(20)] + ["zzgrumfle"] * a + ["qqvalefolk"] * b
            r.shuffle(w)
            out.append((i + seed * 10_000, " ".join(w), int(a and b)))
        return spark.createDataFrame(out, "doc_id long, text string, toxic int")

    terms, data = tox.prepared(rows(3, 1500))
    held = rows(4, 800)
    right = {}
    for name, factors in (("pairs", tox.FACTORS), ("sums", 0)):
        got = tox.score(held, tox.fit(terms, data, factors)).collect()
        right[name] = sum((r.score >= 0.5) == bool(r.toxic) for r in got) / len(got)
        loss = -sum(np.log(r.score if r.toxic else 1 - r.score) for r in got) / len(got)
        right[name + " loss"] = loss
    assert right["pairs"] >= right["sums"] and right["pairs loss"] < 0.8 * right["sums loss"], right


def test_neutral_partner_is_a_term(spark, monkeypatch):
    """A word as frequent in clean texts as in toxic ones, but not beside the insult."""
    r = random.Random(5)
    out = []
    for i in range(2000):
        a = r.random() < 0.5
        b = r.random() < 0.5
        # without the insult the name stands in clean texts more often, which evens it out
        w = ["".join(r.choice("abdehiknorst") for _ in range(5)) for _ in range(20)] + (["zzgrumfle"] * a + ["qqvalefolk"] * b)
        out.append((i, " ".join(w), int(a and (b or r.random() < 0.2))))
    data = spark.createDataFrame([*out, *[(5000 + i, "qqvalefolk and more " + str(i), 0) for i in range(4500)]], "doc_id long, text string, toxic int")
    name = tox.terms_of([b"qqvalefolk"])[1][0]
    assert name in tox.prepared(data)[0]
    monkeypatch.setattr(tox, "PARTNERS", 0)
    assert name not in tox.prepared(data)[0]


def test_rows_bound_the_sample(spark):
    df = spark.createDataFrame([(i % 50, f"text number {i}", i % 2) for i in range(400)], "doc_id long, text string, toxic int")
    assert len(tox.prepared(df, rows=100)[1]) <= 100 and len(tox.prepared(df, rows=400)[1]) == 400


def test_long_words_alike_modulo_powers_of_two():
    from .test_repeats import morse

    a, b = morse(1024)
    _, h = tox.terms_of([a.encode(), b.encode()])
    words = {int(tox.word_hashes(np.frombuffer(t.encode() + b" ", np.uint8), np.array([0]), np.array([1024]))[0]) for t in (a, b)}
    assert len(words) == 2 and words <= set(h.tolist())


def test_terms_match_plain_python():
    import re

    texts = ["Ab cd-ef! été ABCDE", "", "x" * 20, "a b c d e"]
    owner, h = tox.terms_of([t.encode() for t in texts])
    names = {}
    for i, t in enumerate(texts):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())
        words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
        terms = [("w", w) for w in words] + [("g", w[j : j + tox.GRAM]) for w in words for j in range(len(w) - tox.GRAM + 1)]
        assert len(terms) == (owner == i).sum()
        names[i] = terms
    both = {}
    for i in range(len(texts)):
        for term, x in zip(sorted(names[i]), range(len(names[i]))):
            both.setdefault(term, None)
    assert len(np.unique(h)) == len({t for ts in names.values() for t in ts})


def test_edges(spark):
    kinds = "doc_id long, text string, toxic int"
    rows = [(1, None, 1), (2, "", 0), (3, "a " * 50_000, None), (None, "fine words", 0)]
    df = spark.createDataFrame(rows, kinds)
    model = tox.train(df)
    assert all(0 <= r.score <= 1 for r in tox.score(df, model).collect())
    assert tox.score(df.filter("false"), tox.train(df.filter("false"))).count() == 0
    clash = df.withColumn("score", df.doc_id)
    assert tox.score(clash, model).columns == ["doc_id", "text", "toxic", "score"]
