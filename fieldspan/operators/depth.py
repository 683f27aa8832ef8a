"""Depth bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEYS


def to_cm(days: DataFrame, by: Sequence[str] = KEYS, depth: str = "depth") -> DataFrame:
    """A station whose deepest depth is 3 or less is in metres: times 100."""
    deepest = F.max(depth).over(W.partitionBy(*by))
    return days.withColumn(depth, F.when(deepest <= 3, F.col(depth) * 100).otherwise(F.col(depth)))


def depth_bin(depth: Column) -> Column:
    """Bin label of a depth in cm; below 0 or unknown gives the text ``nan``."""
    return (
        F.when(depth.isNull() | F.isnan(depth) | (depth < 0), "nan")
        .when(depth <= 10, "0-10")
        .when(depth <= 30, "10-30")
        .when(depth <= 50, "30-50")
        .otherwise(">50")
    )


def mean_by_bin(days: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Unweighted mean over the depths of a bin for each day."""
    binned = days.withColumn("depth", depth_bin(F.col("depth")))
    return binned.groupBy(*by, "depth", "day").agg(F.avg("value").alias("value"))
