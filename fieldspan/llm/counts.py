"""Token counts by pre-token: each distinct one is encoded once, documents only add up.

Byte-level BPE never merges across pre-tokens, so a text has as many tokens as its
pre-tokens have together. A first pass over the texts gathers the distinct pre-tokens,
which Spark adds up over all tasks and counts the pieces of, once each. A second pass
takes the pre-token frequencies of each document and joins them to those counts: the few
frequent ones by a table of bounded size, all others by a shuffle. No ids are made.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import small
from .common import small_batches, written

#: A pre-token with one in so many of all occurrences is frequent: there are at most so many.
HOT = 1 << 18
#: Bytes of a frequent pre-token at most.
HOT_BYTES = 32
#: Distinct pre-tokens that a task gathers before it passes them on.
HELD = 1 << 16

# The split of byte-level BPE, and the same for ASCII texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = " \t\n\r\f\v"
ASCII_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_SPACE}A-Za-z0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Up to here letters, digits and spaces are the same in every Unicode version in use.
SETTLED = "ԯ"


class Splitter:
    """Pre-tokens of a text, and the special tokens of the file that stand in it.

    Takes files of byte-level BPE without a normaliser whose added tokens match anywhere
    as they are; others raise ValueError.
    """

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        parsed = json.loads(spec)
        split, model = parsed["pre_tokenizer"] or {}, parsed["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and model["type"] == "BPE" and not parsed["normalizer"]
        added = parsed["added_tokens"]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("not a byte-level BPE file with plain added tokens")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._library = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # of two added tokens that begin at one place the longer one counts
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, names))) if names else None
        self._ascii, self._settled = re.compile(ASCII_SPLIT).findall, regex.compile(SPLIT).findall
        self._is_settled = re.compile(f"[\0-{SETTLED}]*").fullmatch

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text whose special tokens are plain text."""
        if text.isascii():
            return self._ascii(text)
        if self._is_settled(text):
            return self._settled(text)
        return [text[a:z] for _, (a, z) in self._library(text)]

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of special tokens between them."""
        if self._special is None or not self._special.search(text):
            return self.pieces(text), 0
        parts = self._special.split(text)
        return [p for part in parts for p in self.pieces(part)], len(parts) - 1

    def sizes(self, pieces: list[str]) -> list[int]:
        """Number of tokens of each pre-token."""
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


_LOADED: dict[str, Splitter] = {}


def splitter(spec: str) -> Splitter:
    """The splitter of a file, one for all tasks of a worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Splitter(spec)
    return _LOADED[key]


def _spec(docs: DataFrame, tokenizer: str):
    """The file, read once on the driver, as a broadcast: its size does not grow with the data."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    Splitter(text)  # a file that cannot be used fails here and not in tasks
    return docs.sparkSession.sparkContext.broadcast(text)


def piece_sizes(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(piece, times, n_tokens): every distinct pre-token of all texts, once.

    ``times`` counts its occurrences. Null texts have none.
    """
    small_batches(docs.sparkSession)
    spec = _spec(docs, tokenizer)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(spec.value).split, Counter()
        out = lambda: pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["piece", "times"])
        for batch in small(batches, text_col):
            for text in batch.column(text_col).to_pylist():
                if text:
                    seen.update(split(text)[0])
            if len(seen) > HELD:
                yield out()
                seen.clear()
        yield out()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = splitter(spec.value).sizes
        for batch in small(batches, "piece"):
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.record_batch([*part.columns, pa.array(sizes(part.column("piece").to_pylist()), pa.int64())], names=["piece", "times", "n_tokens"])

    found = docs.select(text_col).mapInArrow(gather, "piece string, times long")
    return found.groupBy("piece").agg(F.sum("times").alias("times")).mapInArrow(measure, "piece string, times long, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keep, n_bytes, n_tokens) of every row of ``docs``, special tokens in a text counted as such.

    ``tokenizer`` is the path of a byte-level BPE file. Null and empty texts have 0 of
    both; rows count one by one, whatever they repeat, and an empty table gives no rows.
    Other columns, and columns of ``docs`` named as the new ones, are left out.
    """
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens")]
    sizes = written(piece_sizes(docs, tokenizer, text_col))
    total = sizes.agg(F.sum("times")).first()[0] or 0
    frequent = sizes.filter((F.col("times") * HOT > total) & (F.octet_length("piece") <= HOT_BYTES)).select("piece", "n_tokens")
    # fewer than HOT rows by that very share, of HOT_BYTES each
    shared = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in frequent.collect()})
    spec = _spec(docs, tokenizer)
    fields = [T.StructField(f"k{i}_", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField("row_", T.LongType()), *fields, *[T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("piece", T.StringType()), ("times", T.LongType()))]])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the tokens of its frequent pre-tokens, and a row
        for each other pre-token of it."""
        split, known = splitter(spec.value).split, shared.value.get
        for batch in small(batches, "text_"):
            totals, at, pieces, times = [], [], [], []
            for i, text in enumerate(batch.column("text_").to_pylist()):
                found, n = split(text) if text else ((), 0)
                for piece, k in Counter(found).items():
                    size = known(piece)
                    if size is None:
                        at.append(i)
                        pieces.append(piece)
                        times.append(k)
                    else:
                        n += size * k
                totals.append(n)
            row, many = batch.column("row_"), len(at)
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column("text_")), pa.int64()), 0)
            none = lambda kind, n: pa.nulls(n, kind)
            heads = [row, *[batch.column(f.name) for f in fields], size, pa.array(totals, pa.int64()), none(pa.string(), batch.num_rows), none(pa.int64(), batch.num_rows)]
            yield pa.record_batch(heads, names=schema.names)
            if many:
                tails = [row.take(pa.array(at)), *[none(batch.schema.field(f.name).type, many) for f in fields], none(pa.int64(), many), none(pa.int64(), many), pa.array(pieces, pa.string()), pa.array(times, pa.int64())]
                yield pa.record_batch(tails, names=schema.names)

    named = [F.col(c).alias(f.name) for c, f in zip(keep, fields, strict=True)]
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), *named, F.col(text_col).alias("text_")).mapInArrow(tally, schema)
    # rows of documents meet no pre-token: none has a space after another character
    joined = rows.withColumn("at_", F.coalesce("piece", F.concat(F.lit("- "), "row_"))).join(sizes.select(F.col("piece").alias("at_"), F.col("n_tokens").alias("size_")), "at_", "left")
    return joined.groupBy("row_").agg(
        *[F.first(f.name, ignorenulls=True).alias(c) for c, f in zip(keep, fields, strict=True)],
        F.first("n_bytes", ignorenulls=True).alias("n_bytes"),
        (F.sum(F.coalesce("n_tokens", F.col("times") * F.col("size_")))).alias("n_tokens"),
    ).drop("row_")
