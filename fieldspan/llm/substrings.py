"""Dedup of byte strings and of word windows, over the buckets of ``repeats``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import small
from .repeats import Shape, covered, repeated_windows


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def _rows(batch: pa.RecordBatch):
    a, b = batch.column("rep_marks"), batch.column("rep_more")
    texts = batch.column("rep_text").cast(pa.large_binary())
    for i, rid in enumerate(_column(batch, "rep_id")):
        marks = [c[i].values.to_numpy() if c[i].is_valid else None for c in (a, b)]
        yield rid, texts[i].as_py() or b"", marks


def dedup_substrings(docs: DataFrame, length: int = 100, q: int = 25, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Suffix-array dedup by bucket-pointer refinement: bytes that an earlier string covers go.

    Suffixes are dealt to buckets by a q-gram of ``q`` bytes that their first ``length``
    bytes hold, the one of least hash, and only buckets which hold different text stay
    open (``repeats``). The suffixes of open buckets are sorted by bucket pointers
    (``suffixes``): by their first 8 bytes, then by the pointers of suffixes 8, 16, ...
    bytes further on, until ``length`` bytes are compared. The head of a bucket is its
    earliest suffix, and all others of it start a repeated string.

    Returns id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``,
    kept (binary; cutting bytes may break a character). Null texts are empty. Rows
    with a null id keep all bytes. Ids should be unique: rows that share one are
    marked by the places of both. Extra columns are ignored. Ranges of
    neighbouring windows are held equal if 96 bits of their hashes agree, and windows of
    a q-gram that over ``repeats.HOT`` ranges hold if 80 do; all others go by their bytes.
    """
    shape = Shape(length, q, by_word=False, within=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "rep_text"):
            out = []
            for rid, text, marks in _rows(batch):
                gone = covered(shape, len(text), *marks)
                if gone is None:
                    out.append((rid, len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                    continue
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((rid, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 5 + keep_text], names=names[: 5 + keep_text])

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return repeated_windows(docs, shape, id_col, text_col).mapInArrow(run, schema)


def dedup_ngrams(docs: DataFrame, n: int = 13, q: int = 5, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Substring dedup: windows of ``n`` words that also start in a smaller id go.

    Rabin-Karp hashes modulo 2**61 - 1 of all windows of a text come at once from the
    words' hashes. Spark deals them to buckets, neighbouring ones together (``repeats``);
    equal ones are counted there by a sort inside the bucket, not by a Spark aggregate,
    whose one row a window would be several times the text. Repeated windows merge into
    maximal intervals of words.

    Returns id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept (the
    words left, joined by a space). Null texts have no words; rows with a null id keep
    all words; rows that share an id never count against each other and are marked
    by the places of both. Extra columns are ignored.
    """
    shape = Shape(n, q, by_word=True, within=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "rep_text"):
            out = []
            for rid, text, marks in _rows(batch):
                parts = text.split()
                gone = covered(shape, len(parts), *marks)
                kept = b" ".join(parts if gone is None else [w for w, g in zip(parts, gone.tolist(), strict=True) if not g])
                out.append((rid, len(parts), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 4 + keep_text], names=names[: 4 + keep_text])

    names = [id_col, "n_words", "n_removed", "kept_sha256", "kept"]
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return repeated_windows(docs, shape, id_col, text_col).mapInArrow(run, schema)
