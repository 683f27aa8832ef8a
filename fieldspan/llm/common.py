"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

__all__ = ["SPACE", "WORD", "load", "sha256_hex", "small_batches", "spread_join", "word_count", "written"]

#: A word is a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows pass to Python in Arrow batches of at most ``size`` bytes from now on.

    Long texts would else fill buffers of 64 MB a task, outside Spark's memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


#: Share of all rows, and rows, from which a key's rows are spread over several tasks.
HOT_SHARE, HOT_ROWS = 1000, 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], copies: str, spread: Column, how: str = "inner", least_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` joined to the one row of ``right`` for its ``keys``, hot keys in parts.

    ``copies``: the column of ``right`` (a written table) that counts left's rows of a
    key. Keys with over one in ``HOT_SHARE`` of them, and over ``least_rows``, are hot:
    fewer than HOT_SHARE keys by that very share, so their broadcast is bounded. Left's
    rows of a hot key are dealt to parts by ``spread``, and right's row goes to each.
    """
    total = right.agg(F.sum(copies)).first()[0] or 0
    least = max(int(total) // HOT_SHARE, least_rows)
    hot = F.broadcast(right.filter(F.col(copies) > least).select(*keys, F.ceil(F.col(copies) / least).cast("int").alias("parts_")))
    left = left.join(hot, keys, "left").withColumn("part_", F.coalesce(F.pmod(F.xxhash64(spread), "parts_").cast("int"), F.lit(0))).drop("parts_")
    right = right.join(hot, keys, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts_") - 1, F.lit(0))))).drop("parts_")
    return left.join(right, [*keys, "part_"], how).drop("part_")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
