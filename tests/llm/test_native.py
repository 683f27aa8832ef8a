"""Quality rules, PII, line dedup and mixing against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from fieldspan.llm import lines, mixing, pii, quality

from .corpus import frame, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(tri)
    hit = {j for i, t in enumerate(tri) if n[t] > 1 for j in range(i, i + 3)}
    ls = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(hit), len(ls)


def test_quality_measures(spark):
    values = texts() + ["a b a b a b c", "a a a a", " ".join(f"w{i % 90}" for i in range(300)), "é 😀 😀 é 😀 😀", "f", "f a b c f", "\f f of \f"]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    got = {r.doc_id: r for r in quality.cascade(frame(spark, values), measures=names).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        r, want = got[i * 3 + 1], measures(t)
        assert tuple(r[n] for n in names) == want, t
        if want[0] < 50 or 100 * want[4] > 50 * want[0]:
            assert not r.kept


ODD = [
    "\n".join([f"one two three {i} the end of a line..." for i in range(20)]),
    "\n".join([f" - point {i} of the list and more" for i in range(20)]),
    "1 2 3 4 of the " * 30,
    " ".join(f"word{i}" for i in range(80)),
    "the cat and the dog " * 4 + " ".join(f"w{i} of" for i in range(70)),
    " ".join(["spam", "eggs"] * 30 + [f"x{i} the of" for i in range(60)]),
    "a\n" * 80 + "the of and",
]


def own_measures(text):
    words = WORD.findall(text or "")
    ls = (text or "").split("\n")
    return {
        "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|\u2026)[\x20\x09\x0B-\x0D]*$", x)) for x in ls),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09\x0B-\x0D]*[-*\u2022]", x)) for x in ls),
        "n_marks": sum(c < "\x80" and not c.isalpha() and WORD.fullmatch(c) is not None for c in text or ""),
        "n_stop_words": len(set(words) & set(quality.STOP_WORDS)),
        "n_distinct_pairs": len(set(zip(words, words[1:]))),
        "n_distinct_words": len(set(words)),
    }


def test_quality_own_measures(spark):
    values = texts() + ODD
    names = tuple(own_measures(""))
    got = {r.doc_id: r for r in quality.cascade(frame(spark, values), measures=names).collect()}
    for i, t in enumerate(values):
        assert {n: got[i * 3 + 1][n] for n in names} == own_measures(t), t
    # of a text that no base rule rejects, each own rule rejects some
    assert sum(not got[(len(texts()) + i) * 3 + 1].kept for i in range(len(ODD))) >= 5


def test_quality_order_does_not_matter(spark):
    df = frame(spark, texts(1) + ODD)
    one = {r.doc_id: r.kept for r in quality.cascade(df).collect()}
    two = {r.doc_id: r.kept for r in quality.cascade(df, measures=tuple(quality.MEASURES)).collect()}
    three = {r.doc_id: r.kept for r in quality.cascade(df, tuple(reversed(quality.BASE + quality.EXTRA)), ordered=True).collect()}
    assert one == two == three and not all(one.values()) and any(one.values())


def test_quality_rules_after_a_rejection_are_not_evaluated(spark, monkeypatch):
    monkeypatch.setitem(quality.MEASURES, "late", "cast(raise_error('evaluated') as bigint)")
    df = frame(spark, ["too short", None, ""])
    short, late = quality.Rule("short", ("n_words",), "n_words < 50"), quality.Rule("late", ("late",), "late > 0")
    assert [r.kept for r in quality.cascade(df, (short, late), ordered=True).collect()] == [False] * 3
    with pytest.raises(Exception, match="evaluated"):
        quality.cascade(df, (late, short), ordered=True).collect()


def test_quality_order_goes_by_rejections_per_cost(spark, monkeypatch):
    """Of rules that reject alike the cheap one comes first, of rules that cost alike the
    one that rejects more."""
    monkeypatch.setitem(quality.MEASURES, "slow", "cast(size(array_distinct(transform(sequence(1, 20000), i -> xxhash64(i, q_text)))) as bigint)")
    df = frame(spark, ["some words"] * 60 + ["word " * 80] * 60)
    rules = [quality.Rule("slow", ("slow", "n_words"), "slow > 0 and n_words < 50"), quality.Rule("never", ("n_words",), "n_words < 0"), quality.Rule("cheap", ("n_words",), "n_words < 50")]
    assert [r.name for r in quality.cascade_order(df, rules)] == ["cheap", "slow", "never"]


FIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in FIND.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PERSONAL = [
    "é😀 a.b+c@d-e.fg.hi, x@y.zz_w@q.rr @ a@b a@b.c@d.e",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3 99999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111 7 4 0418949746087951 40418949746087 95",
    "+1 (988) 555-2485 +49 30 1234567890123456 + 1 2 +12 +1....2 +1-2-3-4-5-6-7-8",
    "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, DE89370400440532013001",
    "ssn 123-45-6789; 123-45-6789" + " pad" * 30 + " 123-45-6780",
    "1" * 30000,
    "a" * 30000 + "@",
    "1 " * 20000,
    "+1" + "(" * 20000,
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 04dbebab91ab85687d33eeaaf9ac699e1188f962' + " pad" * 20 + " 04dbebab91ab85687d33eeaaf9ac699e1188f963",
    "xDE89370400440532013000 DE89370400440532013000y DE893704004405320130 00",
    "mark \u0001 a@b.cd \u0001\u0002 +1 555 123 4567\u0001",
]


def test_pii(spark):
    values = texts(2) + PERSONAL
    df = pii.find_pii(frame(spark, values))
    got = {r.doc_id: r for r in df.collect()}
    for i, t in enumerate(values):
        r = got[i * 3 + 1]
        assert [(s.kind, s.lo, s.hi) for k in FIND for s in r[f"pii_{k}"]] == base_spans(t), t[:80]
    iban = got[(len(values) - len(PERSONAL) + 4) * 3 + 1].pii_iban
    assert [PERSONAL[4][s.lo : s.hi] for s in iban] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert len(got[(len(values) - len(PERSONAL) + 5) * 3 + 1].pii_ssn) == 2  # the last has no word near it
    assert len(got[(len(values) - 3) * 3 + 1].pii_secret) == 1 and got[(len(values) - 2) * 3 + 1].pii_iban == []


def test_many_matches_cost_in_proportion(spark):
    """A row of 100,000 matches, which a list that grows by each would take hours for."""
    import time

    n = 100_000
    df = spark.createDataFrame([(1, "a@b.cd " * n), (2, "x")], "doc_id long, text string")
    began = time.perf_counter()
    rows = {r.doc_id: r for r in pii.find_pii(df).selectExpr("doc_id", "size(pii_email) as n", "get(pii_email, 99999).lo as lo", "get(pii_email, 99999).hi as hi").collect()}
    assert (rows[1].n, rows[1].lo, rows[1].hi, rows[2].n) == (n, 7 * (n - 1), 7 * n - 1, 0)
    assert time.perf_counter() - began < 60


def test_mixing(spark):
    values = texts(3, 90)
    df = frame(spark, values)
    got = mixing.mix(df).collect()
    assert len(got) == len(values)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        n = len(WORD.findall(r.text or ""))
        assert r.mix_size == n and 0 <= r.taken <= 2 * n
        size[r.source] += n
        taken[r.source] += r.taken
        target[r.source] = r.target
    total, cap = 1.5 * sum(size.values()), {s: 2 * n for s, n in size.items()}
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    want, free = dict.fromkeys(size, 0.0), set(size)
    while True:
        left = total - sum(cap[s] for s in size if s not in free)
        want = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else cap[s] for s in size}
        over = {s for s in free if want[s] > cap[s]}
        if not over:
            break
        free -= over
    for s in size:
        assert target[s] == pytest.approx(want[s]) and taken[s] == int(target[s])
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {i: n for i, n in words.items() if n} == {r.doc_id: r.taken for r in got if r.taken}


def test_mixing_edges(spark):
    empty = frame(spark, ["a b"]).filter("false")
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    nothing = mixing.mix(frame(spark, [None, "", " "])).collect()
    assert {r.taken for r in nothing} == {0}


def line_dedup(docs):
    """docs: (id, chunks) -> kept chunks, by plain comparison of chunk texts."""
    seen, out = set(), {}
    for i, chunks in sorted(docs):
        kept = []
        for c in chunks:
            big = len(c) >= lines.LEAST_CHARS and sum(bool(WORD.search(x)) for x in c.split("\n")) >= lines.LEAST_LINES
            if not (big and c in seen):
                kept.append(c)
            if big:
                seen.add(c)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(spark):
    values = texts(4, 80) + ["\n".join(f"line {i} with a few words of its own {i * i}" for i in range(a, 30)) for a in (0, 0, 3, 5)]
    df = frame(spark, values)
    chunks = {r.doc_id: r.ld_chunks for r in lines.chunked(df).collect()}
    for i, t in enumerate(values):
        assert "\n".join(chunks[i * 3 + 1]) == (t or "")
    want = line_dedup(chunks.items())
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert {i: r.text or "" for i, r in got.items()} == want
    assert sum(r.ld_lines_removed > 0 for r in got.values()) > 5
    assert lines.dedup_lines(df.filter("false")).count() == 0
    assert lines.dedup_lines(df.union(df.limit(3))).count() == len(values) + 3


def test_mixing_of_one_id(spark):
    """Thousands of rows under one id: each counts, none beyond twice its size; which of
    those of one size the cut meets is open, what is taken of them is not."""
    df = spark.range(3000).selectExpr("7L as doc_id", "concat('a b c ', id) as text", "case when id % 3 = 0 then 'u' else 'v' end as source")
    run = lambda d: mixing.mix(d).select("source", "mix_size", "target", "taken").collect()
    rows = run(df)
    assert len(rows) == 3000 and all(0 <= r.taken <= 2 * r.mix_size for r in rows)
    taken, target = Counter(), {r.source: r.target for r in rows}
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sorted(rows) == sorted(run(df.repartition(3)))
