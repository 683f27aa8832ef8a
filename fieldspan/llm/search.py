"""Exact top-k search by inner product over KD-trees, one tree per shard.

Rows are dealt to shards by a hash; a shard's tree splits at medians into tight
bounding boxes. Queries come in blocks. A block visits boxes best first, by the largest
inner products their points could have, each box with those of its queries only whose
bound there reaches the kth score they have so far; a leaf is scored for them at once. In
a task that score goes on from one shard to the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Rows of a shard, of a leaf and of a block of queries; blocks that a task goes through.
SHARD, LEAF, BLOCK, BLOCKS = 4096, 128, 1024, 64
#: Below every score.
LEAST = -(1 << 63)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(s_id, s_vec): floor(scale * x) of each component; rows whose vector is null or
    has a null or non-finite component, and rows with a null id, are left out. A finite
    component whose floor is no long fails the query."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    scaled = lambda v: v.cast("double") * scale
    whole = lambda v: F.when(F.abs(scaled(v)) < 2.0**63, F.floor(scaled(v)).cast("long")).otherwise(F.raise_error(F.lit("a component times the scale is no long")))
    return some.select(F.col(id_col).cast("long").alias("s_id"), F.transform(x, whole).alias("s_vec"))


class Tree:
    """Rows in tree order, and for each node its rows and box; children at 2i+1, 2i+2."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.nodes: list[tuple[int, int, bool]] = []
        order, box = np.arange(len(ids)), []
        todo, where = [(0, len(ids), 0)], {}
        while todo:
            lo, hi, at = todo.pop()
            rows = points[order[lo:hi]]
            low, high = rows.min(0), rows.max(0)
            leaf = hi - lo <= LEAF or not (high > low).any()
            where[at] = (lo, hi, leaf, low, high)
            if not leaf:
                axis, mid = int(np.argmax(high - low)), (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(rows[:, axis], mid)]
                todo += [(lo, lo + mid, 2 * at + 1), (lo + mid, hi, 2 * at + 2)]
        self.ids, self.points = ids[order], points[order]
        self.most = int(np.abs(points).max(initial=0))
        names = sorted(where)
        self.at = {n: i for i, n in enumerate(names)}
        self.names = names
        self.span = [where[n][:3] for n in names]
        box = [(where[n][3], where[n][4]) for n in names]
        self.low, self.high = (np.array(b, np.float64) for b in zip(*box, strict=True))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Of each query and node: no less than the largest inner product a point in the box can have."""
        q = q.astype(np.float64)
        # conversion, products and sums round by less than this share of all that is added
        slack = (q.shape[1] + 8) * 2.0**-52 * (np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.high)).T)
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T + slack

    def scores(self, lo: int, hi: int, q: np.ndarray) -> np.ndarray:
        """Exact inner products of rows and queries: in floating point where all of them and their sums fit."""
        most = q.shape[1] * self.most * int(np.abs(q).max(initial=0))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        return self.points[lo:hi].astype(kind) @ q.astype(kind).T

    def search(self, q: np.ndarray, best: Best) -> None:
        """Add to ``best`` each query's rows that its k best so far leave room for."""
        bounds = self.bounds(q)
        means = bounds.mean(0)
        heap = [(-means[0], 0, np.arange(len(q)))]
        while heap:
            _, at, live = heapq.heappop(heap)
            live = live[bounds[live, self.at[at]] >= best.under[live]]
            if not len(live):
                continue
            lo, hi, leaf = self.span[self.at[at]]
            if not leaf:
                for child in (2 * at + 1, 2 * at + 2):
                    heapq.heappush(heap, (-means[self.at[child]], child, live))
                continue
            for a in range(lo, hi, LEAF):  # a leaf of equal rows may be larger
                s = self.scores(a, min(a + LEAF, hi), q[live])
                # a kth score that the type of s must round lies beyond all of s, and stays there
                row, col = np.nonzero(s >= best.least[live].astype(s.dtype))
                best.add(live[col], s[row, col].astype(np.int64), self.ids[a:hi][row])


class Best:
    """The k best (score, id) so far of each query of a block, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k, self.parts, self.new = query_ids, k, [], 0
        self.least = np.full(len(query_ids), LEAST)
        #: no more than ``least``, as floats
        self.under = np.full(len(query_ids), -np.inf)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows of the queries at ``at``; a row is none of the query of its own id."""
        other = self.query_ids[at] != ids
        self.parts.append((at[other], scores[other], ids[other]))
        self.new += int(other.sum())
        if self.new > 4 * self.k * len(self.query_ids):
            self.settle()

    def settle(self) -> None:
        at, scores, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        full, keep = rank == self.k - 1, rank < self.k
        self.least[at[full]] = scores[full]
        self.under[at[full]] = np.nextafter(scores[full].astype(np.float64), -np.inf)
        self.parts, self.new = [(at[keep], scores[keep], ids[keep])], 0

    def rows(self) -> pd.DataFrame:
        self.settle()
        at, scores, ids = self.parts[0]
        return pd.DataFrame({"query_id": self.query_ids[at], "vec_id": ids, "score": scores})


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    """``n`` vectors, whose components were stored in as few bytes as they need."""
    width = len(blob) // (n * dim) if dim else 8
    return np.frombuffer(blob, f"i{width}").reshape(n, dim).astype(np.int64)


def _packed(df: DataFrame, key: str) -> DataFrame:
    """One row per group of rows of equal dimension: ids and vectors as binary.

    Repeated rows have one hash, so they meet in one group, where one of them stays.
    """

    def run(t: pa.Table) -> pa.Table:
        dim, ids = t["dim"][0].as_py(), t["s_id"].to_numpy()
        vec = t["s_vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        if len(np.unique(ids)) < len(ids):
            _, one = np.unique(np.column_stack([ids, vec]), axis=0, return_index=True)
            ids, vec = ids[one], vec[one]
        low, high = vec.min(initial=0), vec.max(initial=0)
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        row = {"dim": [dim], key: [t[key][0].as_py()], "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "vecs": [vec.astype(kind).tobytes()]}
        return pa.table(row)

    return df.groupBy("dim", key).applyInArrow(run, f"dim long, {key} long, n int, ids binary, vecs binary")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best ``rows`` of each query.

    Both sides as from ``quantised``; ids of ``rows`` are unique, but rows that repeat id
    and vector count once. A row is no candidate for the query of its own id. Only vectors
    of one dimension are compared. A query set without rows, or rows without queries, gives
    an empty result, and fewer than ``k`` rows give all. A task takes some shards and some
    blocks of queries, which is the stated search of all queries against all rows, and
    returns k rows of a query, so no copies of either side are shuffled or broadcast. Scores
    are exact longs; where the dimension times the largest components of both sides leaves
    63 bits, ValueError.
    """
    spark = rows.sparkSession
    small_batches(spark)
    n, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("s_vec")), F.max(_largest())).first()
    asked, ask_dim, ask = queries.agg(F.count(F.lit(1)), F.max(F.size("s_vec")), F.max(_largest())).first()
    if min(dim or 0, ask_dim or 0) * int(most or 0) * int(ask or 0) >= 1 << 63:
        raise ValueError("scores may be no longs")
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    place = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "s_id"), F.lit(parts)).cast("long")
    sized = lambda df, key, salt, parts: df.select("s_id", "s_vec", F.size("s_vec").cast("long").alias("dim"), place(salt, parts).alias(key))
    trees = written(_packed(sized(rows, "shard", 1, shards), "shard"))
    asks = written(_packed(sized(queries, "block", 2, blocks), "block"))
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rank = F.row_number().over(_window())
    every = _visited(trees.repartition(tasks), asks.repartition(-(-blocks // BLOCKS)), k).withColumn("rank", rank).filter(F.col("rank") <= k)
    return every.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _largest():
    """The largest component of a vector in absolute value, as a decimal: a long may have none."""
    ends = [x("s_vec").cast("decimal(20, 0)") for x in (F.array_min, F.array_max)]
    return F.greatest(*map(F.abs, ends))


def _window():
    from pyspark.sql import Window as W

    return W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def _visited(trees: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """The k best rows that each task's trees have for each query of its blocks."""
    t = trees.select("dim", "shard", F.col("n").alias("t_n"), F.col("ids").alias("t_ids"), F.col("vecs").alias("t_vecs"))
    # pairs of partitions, each a task: a tree's blocks follow each other there
    both = t.hint("shuffle_replicate_nl").join(asks, "dim")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, best = None, None, {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.dim, r.shard) != key:
                    key, tree = (r.dim, r.shard), Tree(np.frombuffer(r.t_ids, np.int64), _matrix(r.t_vecs, r.t_n, r.dim))
                if (r.dim, r.block) not in best:
                    best[r.dim, r.block] = Best(np.frombuffer(r.ids, np.int64), k)
                tree.search(_matrix(r.vecs, r.n, r.dim), best[r.dim, r.block])
        for b in best.values():
            yield b.rows()

    return both.mapInPandas(run, "query_id long, vec_id long, score long")
