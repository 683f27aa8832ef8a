"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the terms i of a text that
the model knows. The pair part lets an insult count for more beside a group word than
the sum of both, which additive weights cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASES, STEP, joined, loads, mixed, slices, small, word_hashes, words
from .common import small_batches, written

#: Labelled rows at most that a model is fitted on, the lowest in hash order.
TRAIN_ROWS = 20_000
#: Terms at most in a model: those whose label shares differ most (chi square), over all
#: texts, and PARTNERS more over the texts that hold one of the first, where a word that
#: says nothing alone, such as a group's name, may say much.
TERMS, PARTNERS, LEAST_CHI, LEAST_ROWS = 1024, 16, 30.0, 5
FACTORS, EPOCHS, RATE, DECAY, SEED = 6, 60, 0.3, 1e-5, 7
#: Besides words, every run of so many bytes inside a word is a term: insults inflect.
GRAM = 4

# Terms are runs of letters and digits; A-Z count as a-z, all bytes over 127 as letters.
_SPACES = np.ones(256, bool)
_SPACES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts from (text, index of a term) pairs, each pair once."""
        z = self.bias + np.bincount(owner, self.weight[term], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            z += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word and gram of every text, repeats included."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    done = 0
    for lo, hi in slices(np.array([len(t) for t in texts], np.int64), STEP):
        raw, begin = joined(texts[lo:hi])
        raw = _LOWER[raw]
        start, end = words(raw, _SPACES)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + STEP)))
            a = int(start[i])
            owners.append(np.searchsorted(begin, start[i:j], "right") - 1 + done)
            part = raw[a : int(end[j - 1])]
            hashes.append(word_hashes(part, start[i:j] - a, end[i:j] - a))
            inside = np.zeros(len(part) + 1, np.int32)
            np.cumsum(_SPACES[part], out=inside[1:])
            at = np.flatnonzero(inside[GRAM:] == inside[:-GRAM]) if len(part) >= GRAM else np.zeros(0, np.int64)
            owners.append(np.searchsorted(begin, at + a, "right") - 1 + done)
            hashes.append(mixed(loads(part, GRAM)[at] + BASES[1]))
            i = j
        done += hi - lo
    return np.concatenate(owners), np.concatenate(hashes)


def _pairs(texts: list[bytes], terms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) or, with ``terms``, distinct (text, index of a known term)."""
    owner, h = terms_of(texts)
    if terms is not None:
        if not len(terms):
            return owner[:0], owner[:0]
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        known = terms[at] == h
        pair = np.unique(owner[known] * len(terms) + at[known])
        return pair // len(terms), pair % len(terms)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


def _bounded(some: DataFrame, rows: int) -> DataFrame:
    """``rows`` rows at most, those of the lowest hashes ``o``; copies of a key beyond the
    last whole hash are left out together."""
    low = some.select("o").orderBy("o").limit(rows + 1).agg(F.count("o").alias("n"), F.max("o").alias("cut")).first()
    return some if low.n <= rows else some.filter(F.col("o") < low.cut)


def _telling(hashed: DataFrame, total: int, positive: int, most: int) -> np.ndarray:
    """Sorted hashes of the terms that speak most for the label, from (h, y) rows."""
    if not total or not positive or positive == total:
        return np.zeros(0, np.uint64)
    rate = positive / total
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).filter(F.col("n") >= LEAST_ROWS)
    chi = (F.col("p") - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate) * (1 - F.col("n") / (total + 1)))
    # only terms that speak for the label: clean passages beside an insult hide nothing
    best = counts.withColumn("chi", chi).filter((F.col("chi") >= LEAST_CHI) & (F.col("p") > F.col("n") * rate)).orderBy(F.desc("chi"), "h").limit(most)
    return np.sort(best.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``rows`` labelled rows at most, the lowest in hash order of their key (null
    labels and texts left out).

    Terms are hashed and counted in Spark; what reaches the driver is TERMS + PARTNERS
    terms and, for each row of the bounded sample, the indices of those it holds.
    Repeated rows count each time; without rows of both labels the score is constant.
    """
    terms, data = prepared(labelled, text_col, label_col, key_col, rows)
    y = data["y"]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), 20.0 if len(y) and y.min() else -20.0, np.zeros(0), np.zeros((0, FACTORS)))
    return fit(terms, data)


def prepared(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, pd.DataFrame]:
    """The terms of a model, and (y, x) of each row: its label and its terms' indices."""
    small_batches(labelled.sparkSession)
    some = labelled.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    some = _bounded(some.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(key_col)).alias("o")), rows)

    def hashed(beside: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches, "t"):
                owner, h = _pairs(_binary(batch, "t"))
                y = batch.column("y").to_numpy().astype(np.int64)
                if beside is not None:
                    held = np.bincount(owner[np.isin(h, beside)], minlength=batch.num_rows) > 0
                    keep = held[owner] & ~np.isin(h, beside)
                    # a row of the texts themselves, for their number and labels
                    yield pa.record_batch([pa.nulls(int(held.sum()), pa.int64()), pa.array(y[held])], names=["h", "y"])
                    owner, h = owner[keep], h[keep]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(y[owner])], names=["h", "y"])

        return some.mapInArrow(run, "h long, y long")

    total, positive = some.agg(F.count(F.lit(1)), F.sum("y")).first()
    terms = _telling(hashed(None), total, positive or 0, TERMS)
    if len(terms) and PARTNERS:
        beside = written(hashed(terms))
        total, positive = beside.filter("h is null").agg(F.count(F.lit(1)), F.sum("y")).first()
        terms = np.sort(np.concatenate([terms, _telling(beside.filter("h is not null"), total, positive or 0, PARTNERS)]))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t"):
            texts = _binary(batch, "t")
            owner, at = _pairs(texts, terms)
            lists = np.split(at, np.searchsorted(owner, np.arange(1, len(texts))))
            yield pa.record_batch([batch.column("y"), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["y", "x"])

    return terms, some.mapInArrow(indexed, "y int, x array<int>").toPandas()


def sampled(labels: DataFrame, key_col: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` of the labels, the lowest in hash order of their key."""
    return labels.orderBy(F.xxhash64(key_col), key_col).limit(rows)


def fit(terms: np.ndarray, data: pd.DataFrame, factors: int = FACTORS) -> Model:
    """Logistic loss by AdaGrad over whole batches; the order of rows has no bearing
    but for rounding, as each step sums over a batch of fixed rows. Without ``factors``
    the model is additive."""
    rng = np.random.default_rng(SEED)
    data = data.assign(k=[(tuple(x), y) for x, y in zip(data["x"], data["y"], strict=True)]).sort_values("k").drop(columns="k")
    lists, y = [np.asarray(x, np.int64) for x in data["x"]], data["y"].to_numpy(float)
    model = Model(terms, float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), factors)))
    order = rng.permutation(len(y))
    gw, gv, gb = np.full(len(terms), 1e-6), np.full((len(terms), factors), 1e-6), 1e-6
    for _ in range(EPOCHS if len(terms) else 0):
        for lo in range(0, len(y), 1000):
            rows = order[lo : lo + 1000]
            x = [lists[r] for r in rows]
            owner, term = np.repeat(np.arange(len(x)), [len(a) for a in x]), np.concatenate(x)
            slope = (model.score(owner, term, len(x)) - y[rows]) / len(x)
            s = np.stack([np.bincount(owner, model.factor[term, f], len(x)) for f in range(factors)], 1) if factors else np.zeros((len(x), 0))
            dw = np.bincount(term, slope[owner], len(terms)) + DECAY * model.weight
            each = slope[owner, None] * (s[owner] - model.factor[term])
            dv = np.stack([np.bincount(term, each[:, f], len(terms)) for f in range(factors)], 1) + DECAY * model.factor if factors else model.factor
            gw += dw * dw
            gv += dv * dv
            gb += slope.sum() ** 2
            model.weight -= RATE * dw / np.sqrt(gw)
            model.factor -= RATE * dv / np.sqrt(gv)
            model.bias -= RATE * slope.sum() / np.sqrt(gb)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` plus ``out_col``, 0 to 1; null and empty texts get the score of no terms.

    The model holds TERMS terms at most, which bounds what tasks receive. Rows pass one
    by one; an input column named ``out_col`` is replaced.
    """
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    docs = docs.drop(out_col) if out_col != text_col else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text_col):
            m, texts = shared.value, _binary(batch, text_col)
            owner, term = _pairs(texts, m.terms)
            z = m.score(owner, term, len(texts))
            yield pa.record_batch([*batch.columns, pa.array(z, pa.float64())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)
