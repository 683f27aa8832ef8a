"""Tokens of one tokenizer against those of another.

Both cut the same bytes. Merging the ends of their tokens, a pointer into each, gives a
stretch of bytes for every pair of tokens that overlap, which is a link, and closes a
group wherever both end. Spark counts the documents that hold each linked pair of ids,
takes the largest count of either side, and joins counts and maxima back to the links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import STEP, slices
from .common import small_batches, written
from .counts import Splitter

#: A pair with one in so many of all links is frequent: there are at most so many.
HOT = 1 << 17
#: Stretches of text whose ids a task remembers for each tokenizer.
KNOWN = 1 << 18
#: Distinct links in one row; longer documents take more rows.
ROW_LINKS = 1 << 15


class Coder:
    """Ids of texts, from those of the stretches they split into, each encoded once.

    No merge of the tokenizer reaches from one stretch into the next.
    """

    def __init__(self, byte_strings: list[bytes]):
        self.bytes = byte_strings
        self._sizes = np.array([len(x) for x in byte_strings], np.int64)
        self._known: dict[str, bytes | None] = {}

    def _stretches(self, text: str) -> list[str]:
        raise NotImplementedError

    def _ids(self, stretches: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, fresh: list[str]) -> None:
        """The ids of each as 32-bit integers; None where they do not give it back."""
        found, raw = self._ids(fresh), [s.encode() for s in fresh]
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        ends = np.cumsum([len(i) for i in found])
        sizes = np.append(0, np.cumsum(self._sizes[flat]))[ends]
        packed, cuts = flat.tobytes(), [0, *(4 * ends).tolist()]
        # bytes equal in all, and cut at the same places, are equal one by one
        alike = np.array_equal(sizes, np.cumsum([len(r) for r in raw])) and b"".join(map(self.bytes.__getitem__, flat.tolist())) == b"".join(raw)
        for i, (s, ids) in enumerate(zip(fresh, found, strict=True)):
            same = alike or b"".join(map(self.bytes.__getitem__, ids)) == raw[i]
            self._known[s] = packed[cuts[i] : cuts[i + 1]] if same else None

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text with a space before it, as 32-bit integers; None where their
        bytes are not the space and the text."""
        parts, known = [self._stretches(" " + t) if t else [] for t in texts], self._known
        fresh = list({s for p in parts for s in p if s not in known})
        if len(known) + len(fresh) > KNOWN:
            known.clear()
            fresh = list({s for p in parts for s in p})
        for lo in range(0, len(fresh), 1000):
            self._learn(fresh[lo : lo + 1000])
        out = []
        for p in parts:
            ids = list(map(known.__getitem__, p))
            out.append(None if None in ids else b"".join(ids))
        return out


class ByteLevel(Coder):
    """A byte-level BPE file; strings of special tokens in a text are plain text."""

    def __init__(self, content: bytes):
        splitter = Splitter(content.decode())
        self._stretches, self._tokenizer = splitter.pieces, splitter.tokenizer
        self._tokenizer.encode_special_tokens = True
        parsed = json.loads(content)
        special = {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
        # Printable bytes stand for themselves, the others count from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        entry = {i: bytes(map(byte.__getitem__, t)) for t, i in parsed["model"]["vocab"].items() if i not in special} | special
        super().__init__([entry.get(i, b"") for i in range(max(entry) + 1)])

    def _ids(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]


class Pieces(Coder):
    """A sentencepiece BPE model with byte fallback, which puts the space before a text itself.

    Pieces hold the sign for a space at their start only, or consist of it, so that a
    text falls apart before each run of spaces. Others raise ValueError.
    """

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_proto=content)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece holds a space after another character")
        plain = lambda i, n: bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace("▁", " ").encode()
        super().__init__([plain(i, n) for i, n in enumerate(names)])
        self._split = re.compile(r" +[^ ]+(?: +\Z)?| +").findall

    def _stretches(self, text: str) -> list[str]:
        # the sign itself in a text would stand for a space: such a text stays whole, and fails
        return [text] if "▁" in text else self._split(text)

    def _ids(self, stretches: list[str]) -> list[list[int]]:
        return self._model.encode([s[1:] for s in stretches], num_threads=1)


_LOADED: dict[tuple[str, str], Coder] = {}


def _coder(path: str, content: bytes) -> Coder:
    """The coder of a file, one for all tasks of a worker."""
    key = (path, hashlib.sha256(content).hexdigest())
    if key not in _LOADED:
        _LOADED[key] = Pieces(content) if path.endswith(".model") else ByteLevel(content)
    return _LOADED[key]


@dataclass(frozen=True)
class Merged:
    """Links as positions of tokens on either side, and the group of each token."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> Merged:
    """Both pointers move along the merged ends, each by the ends of its side passed so far.

    ``ends``: where each token ends, rising; both sides end at the same byte. A stretch
    from one end to the next lies in one token of either side, and two tokens overlap in
    one stretch.
    """
    every = np.concatenate([ends_a, ends_b])
    order = np.argsort(every, kind="stable")  # two rising runs: a merge
    every, from_a = every[order], order < len(ends_a)
    final = np.append(every[1:] != every[:-1], True) if len(every) else np.zeros(0, bool)
    passed_a, passed_b = np.cumsum(from_a), np.cumsum(~from_a)
    # an end that both sides have stands twice, a before b
    both = np.zeros(len(every), bool)
    both[1:] = every[1:] == every[:-1]
    stop = np.flatnonzero(final)
    ended_a, ended_b = from_a[stop] | both[stop], ~from_a[stop]
    closed = both[stop]
    group = np.cumsum(closed) - closed
    return Merged(passed_a[stop] - ended_a, passed_b[stop] - ended_b, group[ended_a], group[ended_b], closed[ended_a], closed[ended_b])


class Aligner:
    """Groups and links of texts under two tokenizers."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self._size_a, self._size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        # what a token of a group is written as, the last of its side otherwise
        self._text = [f"{i}," for i in range(len(a.bytes))] + [f"{i}|" for i in range(len(a.bytes))]
        self._text += [f"{i}," for i in range(len(b.bytes))] + [f"{i};" for i in range(len(b.bytes))]

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides; none where either's bytes are not the space and the text."""
        both = zip(self.a.encode(texts), self.b.encode(texts), strict=True)
        return [(b"", b"") if x is None or y is None else (x, y) for x, y in both]

    def align(self, texts: list[str]):
        """For each text n_a, n_b, n_groups, n_links and the groups as text; and of all
        texts the distinct links as (place of the text, id of a, id of b, times)."""
        pairs = self.tokens(texts)
        n_a, n_b = (np.array([len(p[side]) // 4 for p in pairs], np.int64) for side in (0, 1))
        a, b = (np.frombuffer(b"".join(p[side] for p in pairs), np.int32).astype(np.int64) for side in (0, 1))
        # the texts one after the other are one text whose parts end on both sides
        m = merge_ends(np.cumsum(self._size_a[a]), np.cumsum(self._size_b[b]))
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        link_doc, groups = doc_a[m.a], np.bincount(doc_a[m.last_a], minlength=len(texts))
        order = np.argsort(np.concatenate([2 * m.group_a, 2 * m.group_b + 1]), kind="stable")
        skip = 2 * len(self.a.bytes)
        code = np.concatenate([a + m.last_a * len(self.a.bytes), skip + b + m.last_b * len(self.b.bytes)])[order]
        written_as, at, shown = list(map(self._text.__getitem__, code.tolist())), 0, []
        for n in (n_a + n_b).tolist():
            shown.append("".join(written_as[at : at + n])[:-1])
            at += n
        key = (link_doc * len(self.a.bytes) + a[m.a]) * len(self.b.bytes) + b[m.b]
        key, times = np.unique(key, return_counts=True)
        rest, link_b = np.divmod(key, len(self.b.bytes))
        place, link_a = np.divmod(rest, len(self.a.bytes))
        return n_a, n_b, groups, np.bincount(link_doc, minlength=len(texts)), shown, (place, link_a, link_b, times)


def align(docs: DataFrame, a: str, b: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), digests: bool = False) -> DataFrame:
    """(row, keep, n_a, n_b, n_groups, n_links, groups, link_a, link_b, link_n) of all texts.

    ``a``, ``b``: paths of a byte-level BPE file (``.json``) or a sentencepiece model
    (``.model``). ``groups`` reads ``a1,a2|b1;a3|b2``: ids of either side between two
    bytes where both end; with ``digests`` its SHA-256, '' for a text without tokens.
    Distinct links stand in ``link_a`` and ``link_b``, and in ``link_n`` how often. Texts
    that are null or empty, or that a tokenizer does not give back, have no tokens. A
    document of many links takes further rows, with its ``row`` and links but NULL
    elsewhere; documents count one by one, whatever they repeat.
    """
    small_batches(docs.sparkSession)
    kinds = ["n_a", "n_b", "n_groups", "n_links"]
    keep = [c for c in keep if c not in (*kinds, "row", "groups", "link_a", "link_b", "link_n")]
    files = []
    for path in (a, b):
        with open(path, "rb") as f:
            files.append((path, f.read()))
    shared = docs.sparkSession.sparkContext.broadcast(files)
    arrays = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("link_a", "link_b", "link_n")]
    # pandas has no nulls in numbers: these pass as text
    passed = {c: "string" if isinstance(docs.schema[c].dataType, T.AtomicType) else docs.schema[c].dataType for c in keep}
    fields = [T.StructField(c, T.StringType() if k == "string" else k) for c, k in passed.items()]
    schema = T.StructType([T.StructField("row", T.LongType()), *fields, *[T.StructField(c, T.LongType()) for c in kinds], T.StructField("groups", T.StringType()), *arrays])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(*(_coder(*f) for f in shared.value))
        for pdf in batches:
            texts = pdf.pop("text_").fillna("").tolist()
            for lo, hi in slices(np.array([len(t) for t in texts]), STEP):
                yield from rows(aligner, pdf.iloc[lo:hi].reset_index(drop=True), texts[lo:hi])

    def rows(aligner: Aligner, out: pd.DataFrame, texts: list[str]) -> Iterator[pd.DataFrame]:
        n_a, n_b, groups, links, shown, (place, x, y, times) = aligner.align(texts)
        out = out.assign(n_a=n_a, n_b=n_b, n_groups=groups, n_links=links)
        out["groups"] = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown] if digests else shown
        edge = np.searchsorted(place, np.arange(len(texts) + 1)).tolist()
        cut = lambda v: [v[p:q].astype(np.int32) for p, q in zip(edge, [min(q, p + ROW_LINKS) for p, q in zip(edge, edge[1:])])]  # noqa: E731, B905
        out["link_a"], out["link_b"], out["link_n"] = cut(x), cut(y), cut(times)
        yield out[schema.names]
        for i, (p, q) in enumerate(zip(edge, edge[1:], strict=False)):
            for s in range(p + ROW_LINKS, q, ROW_LINKS):
                e = min(q, s + ROW_LINKS)
                more = pd.DataFrame([{"row": out["row"].iloc[i], "link_a": x[s:e].astype(np.int32), "link_b": y[s:e].astype(np.int32), "link_n": times[s:e].astype(np.int32)}])
                yield more.reindex(columns=schema.names).astype(object).where(lambda d: d.notna(), None)

    named = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).cast(k).alias(c) for c, k in passed.items()], F.col(text_col).alias("text_"))
    return named.mapInPandas(run, schema).withColumns({c: F.col(c).cast(docs.schema[c].dataType) for c in keep})


def links(aligned: DataFrame) -> DataFrame:
    """(row, a, b, times): the distinct links of each document."""
    each = aligned.select("row", F.explode(F.arrays_zip("link_a", "link_b", "link_n")).alias("l"))
    return each.select("row", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"), F.col("l.link_n").alias("times"))


def pair_counts(every: DataFrame) -> DataFrame:
    """(a, b, n_docs, most_a, most_b) of every linked pair of ids.

    ``n_docs``: the documents that hold it; ``most``: the largest of these counts that a
    pair of this a, or of this b, has. There are no more maxima than ids of a tokenizer,
    so that these are broadcast whatever the corpus.
    """
    counts = written(every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs")))
    most = lambda side: F.broadcast(counts.groupBy(side).agg(F.max("n_docs").alias(f"most_{side}")))
    return counts.join(most("a"), "a").join(most("b"), "b").select("a", "b", "n_docs", "most_a", "most_b")


def scored(docs: DataFrame, a: str, b: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), digests: bool = False) -> DataFrame:
    """The columns of ``align`` without links, plus n_best and count_sum.

    ``n_best``: links whose count is the highest that their id of ``a`` has anywhere,
    ties included; ``count_sum``: the counts of all links of the document added up.
    Frequent pairs, of which there are at most ``HOT`` by their share of all links, are
    joined by broadcast; what is left is shuffled by pair, none of them frequent.
    """
    aligned = written(align(docs, a, b, text_col, keep, digests))
    every = links(aligned)
    pairs = written(pair_counts(every).select("a", "b", "n_docs", (F.col("n_docs") == F.col("most_a")).alias("best")))
    total = pairs.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.broadcast(pairs.filter(F.col("n_docs") * HOT > total))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")]
    near = every.join(hot, ["a", "b"]).groupBy("row").agg(*sums)
    far = every.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(pairs, ["a", "b"]).groupBy("row").agg(*sums)
    heads = aligned.filter("n_a is not null").drop("link_a", "link_b", "link_n")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in heads.schema.fields if f.name != "row"]
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")]
    parts = heads.select("*", *zero).unionByName(near.select("row", *none, "n_best", "count_sum")).unionByName(far.select("row", *none, "n_best", "count_sum"))
    first = [F.first(c, ignorenulls=True).alias(c) for c in heads.columns if c != "row"]
    return parts.groupBy("row").agg(*first, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")
