"""Token counts, fill-in-middle and alignment against plain loops and the libraries."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from fieldspan.llm import alignment, counts, middle, queries
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .corpus import frame, texts
from .test_bpe import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = ["<P>", "a <S> b", "x<M", "<|endoftext|>", "a  <|endoftext|> <|endoftext|><|endoftext|>b", "▁ a▁b", "<0x0A> <s></s><unk>", "\0\0 a", " lead", "trail \n", "1234 56", "ǅ Ա՘ ৰ 𑃻 ֈ", "é" * 3000, "🙂" * 70]
VALUES = texts(21) + ODD + MORE


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    df = frame(spark, VALUES)
    clash = ["n_bytes", "n_tokens", "piece", "times", "row_", "k0_", "fim_text", "fim_form", "fim_units", "a", "b", "row", "groups", "n_a", "text_", "n_docs"]
    return df.withColumns({c: F.lit("clash") for c in clash}).repartition(5)


# --- token counts ----------------------------------------------------------------------


def test_split_is_the_library_s():
    lib = Tokenizer.from_file(A).pre_tokenizer
    with open(A, encoding="utf-8") as f:
        splitter = counts.Splitter(f.read())
    points = [chr(c) for c in range(0x600)] + list("中文字日本ไทย한😀½ⅷ 　﻿")
    for c in points:
        for s in (f"a{c}1{c} {c}.{c}", f"{c}{c}  {c}\n{c}", f"'s{c}'RE'll {c}"):
            assert splitter.split(s) == ([s[a:z] for _, (a, z) in lib.pre_tokenize_str(s)], 0), s


@pytest.mark.parametrize("hot", [counts.HOT, 20, 1])
def test_counts(docs, monkeypatch, hot):
    monkeypatch.setattr(counts, "HOT", hot)
    monkeypatch.setattr(counts, "HELD", 50)
    lib = Tokenizer.from_file(A)
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in counts.count_tokens(docs, A).collect()}
    want = {(i * 3 + 1, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for i, t in enumerate(VALUES)}
    assert got == want


def test_piece_sizes(spark):
    got = {r.piece: (r.times, r.n_tokens) for r in counts.piece_sizes(frame(spark, ["the cat", "the  cat's", None, ""]), A).collect()}
    assert got == {"the": (2, 1), " cat": (2, 1), " ": (1, 1), "'s": (1, 1)}


def test_counts_of_repeated_rows_and_keys(spark):
    df = frame(spark, ["one two", None]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = counts.count_tokens(df.union(df), A, keep=["doc_id", "source", "lang"]).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_tokens) for r in rows) == [(True, 0, 0)] * 2 + [(True, 7, 2)] * 2
    assert counts.count_tokens(df.filter("false"), A).count() == 0
    with pytest.raises(ValueError):
        counts.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"))


# --- fill-in-middle --------------------------------------------------------------------


def by_hand(i, text):
    t = text or ""
    h = [int(sha(f"1:{i}")[8 * j : 8 * j + 8], 16) for j in range(4)]
    n = len(t)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("known", [middle.KNOWN, 7])
def test_middle(docs, monkeypatch, known):
    monkeypatch.setattr(middle, "KNOWN", known)
    df = middle.fill_in_middle(docs)
    rows = df.withColumn("back", middle.restored(F.col("fim_text"), F.col("fim_form"))).collect()
    assert len(rows) == len(VALUES)
    for r in rows:
        size = lambda s: None if s is None else len(s)
        assert (r.fim_units, r.fim_form, size(r.fim_prefix), size(r.fim_middle), r.fim_text) == by_hand(r.doc_id, r.text), r.text
        assert r.back == (r.text or "")
    assert {r.fim_form for r in rows} == {"plain", "psm", "spm"}


def test_middle_of_words(spark):
    df = middle.fill_in_middle(frame(spark, ["one two  three\nfour"] * 30), plain_from=100, unit=r"\s*\S+")
    for r in df.collect():
        assert r.fim_units == 4 and r.fim_prefix + r.fim_middle + r.fim_suffix == r.text
        assert len(r.fim_prefix) in (0, 3, 7, 14, 19) and len(r.fim_prefix + r.fim_middle) in (0, 3, 7, 14, 19)
    assert len({r.fim_prefix for r in df.collect()}) > 2


def test_middle_rows(spark):
    df = frame(spark, ["abc def", None]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = middle.fill_in_middle(df.union(df)).collect()
    assert len(rows) == 4 and sorted(r.fim_text for r in rows)[:2] == ["", ""]
    assert middle.fill_in_middle(df.filter("false")).count() == 0


def test_middle_sql(spark, tmp_path):
    values = [t for t in VALUES if t is None or "\0" not in t]
    frame(spark, values).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(queries.SQL["op12_middle"])
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in got.select(*rel.columns).collect())


# --- alignment -------------------------------------------------------------------------


def tokens(lib, sp, names, t):
    if not t:
        return [], []
    x, y = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
    plain = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return ([(i, names[i]) for i in x], [(i, plain(i)) for i in y]) if b"".join(map(plain, y)) == (" " + t).encode() else ([], [])


@pytest.fixture(scope="module")
def expected():
    lib, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    at = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    names = {i: bytes(at[c] for c in t) if i != 50256 else t.encode() for t, i in lib.get_vocab().items()}
    out, held = [], Counter()
    for t in VALUES:
        x, y = tokens(lib, sp, names, t)
        spans = []
        for side in (x, y):
            ends = np.cumsum([len(s) for _, s in side]).tolist()
            spans.append([(e - len(s), e, i) for e, (i, s) in zip(ends, side)])
        pairs, j = [], 0
        for s, e, i in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                pairs.append((i, spans[1][k][2]))
                k += 1
        held.update(set(pairs))
        stops = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for hi in stops:
            inside = [",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in spans]
            groups.append("|".join(inside))
            lo = hi
        out.append((len(x), len(y), pairs, groups))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return {k * 3 + 1: (a, b, len(g), len(p), sum(held[q] == best[q[0]] for q in p), sum(held[q] for q in p), ";".join(g)) for k, (a, b, p, g) in enumerate(out)}


@pytest.mark.parametrize(("hot", "row_links"), [(alignment.HOT, alignment.ROW_LINKS), (30, 3), (1, 50)])
def test_alignment(docs, monkeypatch, expected, hot, row_links):
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "ROW_LINKS", row_links)
    monkeypatch.setattr(alignment, "STEP", 500)
    monkeypatch.setattr(alignment, "KNOWN", 100 if row_links == 3 else alignment.KNOWN)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in alignment.scored(docs, A, B).collect()}
    assert got == expected
    assert any(v[0] == 0 and t for v, t in zip(expected.values(), VALUES))


def test_pair_counts(spark):
    rows = [(1, 1, 1, 2), (1, 1, 2, 1), (2, 1, 1, 1), (2, 3, 2, 1), (3, 3, 2, 9), (4, 3, 2, 1)]
    got = {tuple(r) for r in alignment.pair_counts(spark.createDataFrame(rows, "row long, a int, b int, times int")).collect()}
    assert got == {(1, 1, 2, 2, 2), (1, 2, 1, 2, 3), (3, 2, 3, 3, 3)}


def test_alignment_rows(spark):
    df = frame(spark, ["one two", None]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(2.5))
    rows = alignment.scored(df.union(df), A, B, keep=["doc_id", "source"], digests=True).collect()
    assert sorted((r.doc_id, r.source, r.n_a, r.groups == "") for r in rows) == [(None, 2.5, 0, True)] * 2 + [(None, 2.5, 2, False)] * 2
    big = spark.createDataFrame([((1 << 53) + 1, "x"), (None, "y")], "doc_id long, text string")
    assert {r.doc_id for r in alignment.scored(big, A, B).collect()} == {(1 << 53) + 1, None}
    assert alignment.scored(df.filter("false"), A, B).count() == 0
