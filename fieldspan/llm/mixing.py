"""Mixing sources to target weights.

Every row gets a hash-random key, rows are put in key order within their source,
distributed prefix sums of token counts run along that order, and each source is
cut at its exact budget; whole epochs repeat where the budget exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, word_count, written

#: Rows of one hash range within a source; ranges, not sources, are what a task sorts.
RANGE_ROWS = 128


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Per source: its size, its number of rows and its target in words.

    Sources in code point order (null last) take the weights in turn and share
    ``share`` times all sizes. A target stops at ``cap`` times the source's size
    and the excess is shared again by weight, which is water filling: in order of
    cap over weight, a source is capped while its cap lies under the level that
    the rest would reach. One row per source goes through the windows here.
    """
    every = W.orderBy(F.lit(1))
    src = sized.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(W.orderBy(F.col("mix_source").isNull(), "mix_source")) - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("w", pick).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    src = src.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    asc = W.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").isNull(), "mix_source")
    before = F.coalesce(F.sum("cap").over(asc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(asc.rowsBetween(0, W.unboundedFollowing))
    src = src.withColumn("capped", F.col("cap") * rest <= F.col("w") * (F.col("total") - before))
    both = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    gone = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(both), F.lit(0.0))
    left = F.sum(F.when(~F.col("capped"), F.col("w"))).over(both)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * (F.col("total") - gone) / left)
    return src.select("mix_source", "source_size", "source_rows", target.alias("target"))


def _prefix(df: DataFrame, keys: list[str]) -> DataFrame:
    """``before``: words of the ranges ahead of each one, by two levels of ranges,
    so that no task sees more than the square root of a source's ranges."""
    fine = df.groupBy(*keys, "coarse", "fine").agg(F.sum("mix_size").alias("n"))
    inner = W.partitionBy(*keys, "coarse").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("coarse").rowsBetween(W.unboundedPreceding, -1)
    coarse = fine.groupBy(*keys, "coarse").agg(F.sum("n").alias("m"))
    coarse = coarse.select(*keys, "coarse", F.coalesce(F.sum("m").over(outer), F.lit(0)).alias("ahead"))
    fine = fine.select(*keys, "coarse", "fine", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("within"))
    on = [fine[k].eqNullSafe(coarse[k]) for k in [*keys, "coarse"]]
    return fine.join(coarse, on).select(*[fine[k] for k in [*keys, "coarse", "fine"]], (F.col("ahead") + F.col("within")).alias("before"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """``docs`` (all columns) plus ``mix_size``, ``source_size``, ``target``, ``taken``.

    ``taken`` counts the words the mix takes of the row, repeats included: whole
    epochs, then the rows ahead in key order, then a part of the row at the cut.
    Null ids, texts and sources are ordinary values (a null text has 0 words, null
    sources form the last source); repeated rows are rows of their own and ties in
    the key fall by id and size; of rows alike in both, which of them the cut meets is
    open, and how many words each place takes is not. An empty table gives an empty result. Columns of
    the input with the names added here are replaced. Only one row per source and
    per range of keys is ever aggregated; a hot source is split by key ranges.
    """
    own = ["mix_size", "mix_key", "mix_source", "source_size", "source_rows", "target", "taken", "coarse", "fine", "before"]
    docs = docs.drop(*[c for c in own if c not in (id_col, text_col, source_col)])
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.withColumn("mix_size", word_count(F.col(text_col))).withColumn("mix_key", key).withColumn("mix_source", F.col(source_col))
    slim = written(rows.select("mix_source", "mix_size", "mix_key"))
    targets = written(source_targets(slim, weights, share, cap), 1)

    def ranged(df: DataFrame) -> DataFrame:
        t = targets.withColumnRenamed("mix_source", "t_source")
        bits = F.greatest(F.lit(0), F.least(F.lit(31), F.ceil(F.log2(F.col("source_rows") / RANGE_ROWS)))).cast("int")
        high = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long")
        df = df.join(t, df["mix_source"].eqNullSafe(t["t_source"])).drop("t_source").withColumn("bits", bits)
        df = df.withColumn("fine", F.expr("0L")).withColumn("high", high)
        return df.withColumn("fine", F.expr("shiftright(high, 32 - bits)")).withColumn("coarse", F.expr("shiftright(fine, bits div 2)").cast("long")).drop("bits", "high")

    offsets = _prefix(ranged(slim), ["mix_source"]).select(F.col("mix_source").alias("o_source"), F.col("fine").alias("o_fine"), "before")
    # slim columns first where that is all the caller keeps: Catalyst prunes the text
    full = ranged(rows)
    full = full.join(offsets, full["mix_source"].eqNullSafe(offsets["o_source"]) & (full["fine"] == offsets["o_fine"])).drop("o_source", "o_fine")
    run = W.partitionBy("mix_source", "fine").orderBy("mix_key", id_col, "mix_size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("mix_size").over(run), F.lit(0))
    budget = F.floor("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.expr("cast(floor(target) as bigint) div greatest(source_size, 1)")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("mix_size"), budget - epochs * size - start))
    return full.withColumn("taken", epochs * F.col("mix_size") + part).drop("mix_key", "mix_source", "coarse", "fine", "before", "source_rows")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per epoch a document
    takes part in, the last one cut to the words that the budget still holds."""
    text = kw.get("text_col", "text")
    cols = docs.columns
    m = mix(docs, **kw)
    m = m.withColumn("mix_copies", F.expr("cast(ceil(taken / greatest(mix_size, 1)) as int)")).filter("mix_copies > 0")
    m = m.withColumn("mix_copy", F.explode(F.expr("sequence(1, mix_copies)")))
    words = F.expr("least(mix_size, taken - (mix_copy - 1) * mix_size)")
    pieces = F.split(F.col(text), rf"(?<=[^\x20\x09-\x0D])(?={SPACE})")
    cut = F.when(words >= F.col("mix_size"), F.col(text)).otherwise(F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""))
    return m.withColumn(text, cut).select(*cols)
