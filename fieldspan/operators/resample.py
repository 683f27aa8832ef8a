"""Means over sensors and days, on a dense daily grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEYS


def mean_by_depth(obs: DataFrame, by: Sequence[str] = KEYS, depth: str = "depth_to", ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean over the sensors of a depth at each time; a NULL depth belongs nowhere."""
    day = F.to_date(ts).alias("day")
    rows = obs.filter(F.col(depth).isNotNull()).select(*by, F.col(depth).alias("depth"), day, F.col(ts).alias("ts"), F.col(value).alias("value"))
    # by day as well: the daily mean that follows then needs no second exchange
    return rows.repartition(*by, "depth", "day").groupBy(*by, "depth", "day", "ts").agg(F.avg("value").alias("value"))


def daily(means: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the day's times and their number (times with a value, not raw rows)."""
    return means.groupBy(*by, "depth", "day").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def drop_empty_depths(days: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Without depths that never have a value, but with the span of the whole station.

    Adds ``first_day`` and ``last_day``, taken before any depth goes.
    """
    station, series = W.partitionBy(*by), W.partitionBy(*by, "depth")
    spanned = days.repartition(*by).select("*", F.min("day").over(station).alias("first_day"), F.max("day").over(station).alias("last_day"), F.count("value").over(series).alias("valid"))
    return spanned.filter("valid > 0").drop("valid")


def densify(days: DataFrame, by: Sequence[str] = KEYS, values: Sequence[str] = ("value", "n")) -> DataFrame:
    """One row for every day of the station's span and every depth; NULL where no data.

    Each day is stretched to the next one that exists, so that no grid is joined. Needs
    ``first_day`` and ``last_day``; without them the rows given span the station.
    """
    station = W.partitionBy(*by)
    if "first_day" not in days.columns:
        days = days.repartition(*by).select("*", F.min("day").over(station).alias("first_day"), F.max("day").over(station).alias("last_day"))
    order = W.partitionBy(*by, "depth").orderBy("day")
    start = F.when(F.lag("day").over(order).isNull(), F.col("first_day")).otherwise(F.col("day"))
    stop = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.col("last_day"))
    each = days.select("*", start.alias("start_"), stop.alias("stop_")).withColumn("on", F.explode(F.sequence("start_", "stop_")))
    own = F.col("on") == F.col("day")
    return each.select(*by, "depth", F.col("on").alias("day"), *[F.when(own, F.col(v)).alias(v) for v in values])


def require_count(days: DataFrame, least: int = 6) -> DataFrame:
    """The day's mean only if at least ``least`` times had a value."""
    return days.withColumn("value", F.when(F.col("n") >= least, F.col("value"))).drop("n")
