"""Trimming series to common or surface periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEYS
from .gaps import bridge_gaps, numbered_islands


def common_period(runs: DataFrame, min_frac: float = 0.95, by: Sequence[str] = KEYS) -> DataFrame:
    """Depths whose longest run has ``min_frac`` of the station's longest, and their
    common ``start`` and ``end``. Stations without a run give no rows."""
    station = W.partitionBy(*by)
    kept = runs.withColumn("most", F.max("run_days").over(station))
    kept = kept.filter((F.col("run_days") > 0) & F.col("run_start").isNotNull() & F.col("run_end").isNotNull() & (F.col("run_days") >= min_frac * F.col("most")))
    return kept.select(*by, "depth", F.max("run_start").over(station).alias("start"), F.min("run_end").over(station).alias("end"))


def trim_to_common_period(series: DataFrame, runs: DataFrame, min_frac: float = 0.95, by: Sequence[str] = KEYS) -> DataFrame:
    """The kept depths between the common start and end, both included."""
    period = common_period(runs, min_frac, by)
    return series.join(period, [*by, "depth"]).filter(F.col("day").between(F.col("start"), F.col("end"))).drop("start", "end")


def trim_to_surface_window(series: DataFrame, runs: DataFrame, min_frac: float = 0.95, surface: str = "0-10", by: Sequence[str] = KEYS) -> DataFrame:
    """All depths inside the surface depth's longest run, its last day left out; depths
    with values on fewer than ``min_frac`` of those days go, the surface depth too."""
    window = runs.filter((F.col("depth") == surface) & (F.col("run_days") > 0)).select(*by, F.col("run_start").alias("start"), F.col("run_end").alias("end"))
    return inside_surface_window(series.join(window, list(by)), min_frac, by)


def mark_surface_window(series: DataFrame, max_gap_days: int = 7, surface: str = "0-10", by: Sequence[str] = KEYS) -> DataFrame:
    """``series`` plus ``start`` and ``end``: the surface depth's longest available run.

    As ``longest_available_run`` and a join would give, but over windows of the station
    only. Both are NULL for a station without such a run.
    """
    marked = numbered_islands(bridge_gaps(series, max_gap_days, by), by, "available")
    run = W.partitionBy(*by, "depth", "available", "island")
    first, last, size = F.min("day").over(run), F.max("day").over(run), F.count(F.lit(1)).over(run)
    marked = marked.select("*", size.alias("len_"), first.alias("a_"), last.alias("z_"))
    one = F.struct(F.col("len_"), -F.unix_date("a_"), F.col("a_").alias("a"), F.col("z_").alias("z"))
    best = F.max(F.when((F.col("depth") == surface) & F.col("available"), one)).over(W.partitionBy(*by))
    marked = marked.withColumn("best_", best)
    return marked.select("*", F.col("best_.a").alias("start"), F.col("best_.z").alias("end")).drop("available", "island", "len_", "a_", "z_", "best_")


def coverage(series: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, depth, coverage): the share of a depth's days that have a value."""
    return series.groupBy(*by, "depth").agg(_share().alias("coverage"))


def _share() -> Column:
    return F.avg(F.col("value").isNotNull().cast("double"))


def inside_surface_window(marked: DataFrame, min_frac: float = 0.95, by: Sequence[str] = KEYS) -> DataFrame:
    """Rows of a marked series from ``start`` to before ``end``, of depths with values on
    ``min_frac`` of those days."""
    inside = marked.filter((F.col("day") >= F.col("start")) & (F.col("day") < F.col("end"))).drop("start", "end")
    return inside.withColumn("share", _share().over(W.partitionBy(*by, "depth"))).filter(F.col("share") >= min_frac).drop("share")
