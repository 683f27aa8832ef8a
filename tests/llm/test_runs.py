"""Repeated passages of lines against all windows in plain Python."""

import random

from fieldspan.llm import lines

from .corpus import frame, texts
from .test_native import WORD


def units(text):
    """(line, text with the blank lines that go along) of each line that is not blank."""
    out, head = [], []
    for x in (text or "").split("\n"):
        if WORD.search(x):
            out.append([x, [*head, x]])
            head = []
        elif out:
            out[-1][1].append(x)
        else:
            head.append(x)
    return out


def brute(docs):
    """docs: (id, text) -> (text, lines removed), by comparing every window of lines."""
    seen, out = {}, {}
    for d, text in sorted(docs):
        u = units(text)
        gone = set()
        for i in range(len(u)):
            for j in range(i + 2, len(u) + 1):
                w = tuple(x for x, _ in u[i:j])
                if len("\n".join(w)) >= 80:
                    first = seen.setdefault(w, (d, i))
                    if first[0] < d or first[1] + len(w) <= i:
                        gone.update(range(i, j))
        kept = [x for i, (_, part) in enumerate(u) if i not in gone for x in part]
        out[d] = ("\n".join(kept), len((text or "").split("\n")) - len(kept)) if gone else (text or "", 0)
    return out


def planted():
    """Passages of 2 to 9 lines, short ones among them, between lines of their own."""
    r = random.Random(21)
    own = lambda k: [f"own {r.random()} " + "w " * r.randrange(1, 40) for _ in range(k)]
    passages = [[f"passage {i} line {j} " + "x" * r.choice([1, 5, 30, 90]) for j in range(2 + i % 8)] for i in range(16)]
    docs = ["\n".join([*own(3), *p, *own(2)]) for p in passages]
    docs += ["\n".join([*own(2), *r.choice([p, p[:-1], [*p[:1], "", *p[1:]]]), *own(3)]) for p in passages]
    copies = ["\n".join(own(k)) for k in (2, 3, 5, 8, 40)] + ["\n\n" + "\n \n".join(own(6)) + "\n\n"]
    return docs + copies + copies + ["\n".join(["a b"] * 100), "\n".join(["c", "d " * 50] * 5), "\n".join("efghijklmn" * 20), "\n".join("fghijklmne" * 20)]


def test_runs(spark):
    values = texts(4, 80) + planted()
    got = {r.doc_id: (r.text or "", r.ld_lines_removed) for r in lines.dedup_runs(frame(spark, values)).collect()}
    assert got == brute([(i * 3 + 1, t) for i, t in enumerate(values)])


def test_any_chunks_give_the_same(spark):
    """Whatever the chunks, of one line or of whole texts, what they miss is grown."""
    values = planted()
    want = brute([(i * 3 + 1, t) for i, t in enumerate(values)])
    for spread in (1, 2, 1000):
        got = {r.doc_id: (r.text or "", r.ld_lines_removed) for r in lines.dedup_runs(frame(spark, values), spread=spread).collect()}
        assert got == want


def test_copies_post_chunks(spark):
    """Of a later copy whole chunks are compared, and lines grown inside them are not."""
    text = "\n".join(f"line {i} " + "word " * 20 + str(i * i) for i in range(60))
    df = frame(spark, [text, text])
    rows = lines._passages(df.withColumnRenamed("doc_id", "ld_id"), "text", lines.SPREAD).collect()
    chunks = [r for r in rows if r.ld_whole]
    assert chunks and all(r.ld_in == r.ld_w for r in chunks)
    assert any(r.ld_in is None for r in rows) and any(r.ld_in is not None and not r.ld_whole for r in rows)
    assert len({(r.ld_id, r.ld_w, r.ld_whole) for r in rows}) == len(rows)
    gone = {r.ld_id: {(c.ld_w >> 32, c.ld_w & (1 << 32) - 1) for c in r.ld_gone} for r in lines.repeated_passages(df).collect()}
    whole = {(r.ld_w >> 32, r.ld_w & (1 << 32) - 1) for r in chunks}
    assert set(gone) == {4} and whole <= gone[4]
    inside = lambda w: any(a <= w[0] and w[0] + w[1] <= a + k for a, k in whole)
    assert not any(inside(w) for w in gone[4] - whole)


def test_many_lines(spark):
    text = "\n".join(f"line {i} of one text {i * i}" for i in range(30000))
    got = {r.doc_id: r.ld_lines_removed for r in lines.dedup_runs(frame(spark, [text, "a b c d\n" * 30000, text])).collect()}
    assert got == {1: 0, 4: 29990, 7: 30000}


def test_exact_copies_become_empty(spark):
    r = random.Random(22)
    values = ["\n".join(f"{i} {j} {r.random()} words of its own to be long enough" for j in range(2 + i % 7)) for i in range(20)]
    got = lines.dedup_runs(frame(spark, values * 2)).collect()
    assert len(got) == 40 and all(x.text == (values[x.doc_id // 3] if x.doc_id < 60 else "") for x in got)


def test_odd_rows(spark):
    t, u = "one line of text that is long enough to go\nand another one that makes the passage long", "other"
    rows = [(None, t), (3, t), (3, u), (4, f"{t}\n{u}"), (4, "short"), (5, None), (6, ""), (7, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.text, x.ld_lines_removed) for x in lines.dedup_runs(df).collect()), key=str)
    want = [(None, t, 0), (3, "", 2), (3, u, 0), (4, u, 2), (4, "short", 0), (5, None, 0), (6, "", 0), (7, " \n", 0)]
    assert got == sorted(want, key=str)
    assert lines.dedup_runs(df.filter("false")).count() == 0


def test_query(spark, tmp_path):
    from fieldspan.llm import queries

    text = "\n".join(f"line {i} with a few words of its own {i * i}" for i in range(30))
    spark.createDataFrame([(1, text), (2, f"x\n{text}\ny"), (3, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.ld_lines_removed, r.kept_chars) for r in queries.op7_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (0, len(text)), 2: (30, 3), 3: (30, 0)}
