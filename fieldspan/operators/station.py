"""One status row per station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS

# The remarks of the decision table.
NO_DATA = "no valid data after process_station"
NO_SURFACE = "no surface run for 0-10 after removing long gaps"
TOO_SHORT = "<1 year of valid daily data"
STILL_NULL = "NaNs remain after gap-filling"


def status(stations: DataFrame, found: DataFrame, marked: DataFrame, filled: DataFrame, by: Sequence[str] = KEYS, min_days: int = 365, flag: str = "value_qc", problems: DataFrame | None = None) -> DataFrame:
    """The decision for each row of ``stations``; the first that holds counts.

    ``found``: keys and max_depth of stations with any valid depth. ``marked``: the
    series with its surface window. ``filled``: the trimmed and filled rows, whose
    ``flag`` tells what was observed. Columns a decision does not reach are NULL, as
    are the coordinates of a station without data. ``problems`` (keys, n_problems,
    problem): a station named there is an ``error`` with that remark before all else,
    whatever its good lines give; only then the result has ``n_problems``.
    """
    top = marked.groupBy(*by).agg(F.max(F.col("start").isNotNull()).alias("has_surface"))
    seen = F.when(F.col(flag) == 0, F.col("day"))
    rest = filled.groupBy(*by).agg(
        F.min(seen).alias("first_valid"), F.max(seen).alias("last_valid"), F.size(F.collect_set(seen)).alias("n_days"),
        F.count_if(F.col("value").isNull()).alias("n_null"), F.array_sort(F.collect_set("depth")).alias("all_depths"),
    )
    s = stations.join(found.withColumn("has_data", F.lit(True)), list(by), "left").join(top.filter("has_surface"), list(by), "left").join(rest, list(by), "left")
    n_days = F.coalesce("n_days", F.lit(0))
    step = (
        F.when(F.col("has_data").isNull(), 1).when(F.col("has_surface").isNull(), 2).when(n_days < min_days, 4).when(F.col("n_null") > 0, 5).otherwise(6)
    )
    if problems is not None:
        s = s.join(problems, list(by), "left")
        step = F.when(F.col("n_problems") > 0, 0).otherwise(step)
    s = s.withColumn("step", step)
    remark = F.when(F.col("step") == 0, F.col("problem")) if problems is not None else F
    remark = remark.when(F.col("step") == 1, NO_DATA).when(F.col("step") == 2, NO_SURFACE).when(F.col("step") == 4, TOO_SHORT).when(F.col("step") == 5, STILL_NULL).otherwise("")
    at = lambda least, col: F.when(F.col("step") >= least, col)
    day = lambda c: F.date_format(c, "yyyyMMdd")
    name = F.concat(F.concat_ws("_", *by, day("first_valid"), day("last_valid")))
    return s.select(
        *by, F.when(F.col("step") == 6, "saved").when(F.col("step") == 0, "error").otherwise("skipped").alias("status"), remark.alias("remark"),
        at(2, F.col("latitude")).alias("latitude"), at(2, F.col("longitude")).alias("longitude"),
        at(4, day("first_valid")).alias("start_date"), at(4, day("last_valid")).alias("end_date"), at(4, n_days).cast("long").alias("n_days"),
        at(6, F.col("max_depth") * 100).alias("max_depth_cm"), at(6, F.col("all_depths")).alias("depths"), at(6, name).alias("filename"),
        *([F.coalesce("n_problems", F.lit(0)).alias("n_problems")] if problems is not None else []),
    )


def totals(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stations per status and remark, over all or for each of ``by``."""
    return table.groupBy(*by, "status", "remark").agg(F.count(F.lit(1)).alias("stations"))
