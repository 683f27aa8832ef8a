"""Missing and available runs on a dense daily grid, by gaps and islands.

Series are rows (keys, depth, day, value) with one row for every day. All windows of a
series share its keys, so one exchange serves them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEYS


def missing_days_per_year(series: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Missing days of each depth and calendar year, of the days on the axis."""
    missing = F.sum(F.col("value").isNull().cast("long"))
    return series.groupBy(*by, "depth", F.year("day").cast("long").alias("year")).agg(missing.alias("missing_days"))


def numbered_islands(series: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    """``series`` plus ``island``: equal for neighbouring days of one state."""
    all_days = W.partitionBy(*by, "depth").orderBy("day")
    same = W.partitionBy(*by, "depth", state).orderBy("day")
    return series.withColumn("island", F.row_number().over(all_days) - F.row_number().over(same))


def _longest(series: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    """Per series the longest island where ``state`` holds, the first on ties."""
    runs = numbered_islands(series, by, state).groupBy(*by, "depth", state, "island").agg(F.count(F.lit(1)).alias("len"), F.min("day").alias("a"), F.max("day").alias("z"))
    run = F.when(F.col(state), F.struct(F.col("len"), F.col("a"), F.col("z")))
    best = F.max_by(run, F.when(F.col(state), F.struct(F.col("len"), -F.unix_date("a"))))
    best = runs.groupBy(*by, "depth").agg(best.alias("r"))
    return best.select(*by, "depth", F.coalesce("r.len", F.lit(0)).cast("long").alias("run_days"), F.col("r.a").alias("run_start"), F.col("r.z").alias("run_end"))


def longest_missing_run(series: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Length, first and last day of the longest missing run; (0, NULL, NULL) for none."""
    return _longest(series.withColumn("gone", F.col("value").isNull()), by, "gone")


def bridge_gaps(series: DataFrame, max_gap_days: int = 7, by: Sequence[str] = KEYS) -> DataFrame:
    """``series`` plus ``available``: a value, or in a missing run of at most
    ``max_gap_days`` days, at either end of the record as well. Values stay NULL."""
    marked = numbered_islands(series.withColumn("gone", F.col("value").isNull()), by, "gone")
    size = F.count(F.lit(1)).over(W.partitionBy(*by, "depth", "gone", "island"))
    return marked.withColumn("available", ~F.col("gone") | (size <= max_gap_days)).drop("gone", "island")


def longest_available_run(series: DataFrame, max_gap_days: int = 7, by: Sequence[str] = KEYS) -> DataFrame:
    """Longest run of available days once short gaps are bridged."""
    return _longest(bridge_gaps(series, max_gap_days, by), by, "available")
