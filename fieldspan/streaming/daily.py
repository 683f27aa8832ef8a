"""Daily means over a stream of observations.

Runs and climatologies need the whole record and stay batch jobs; the daily mean is the
part that can follow a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS
from ..operators.qc import mask_flags


def daily_stream(obs: DataFrame, late: str = "1 day", by: Sequence[str] = KEYS, depth: str = "depth_to") -> DataFrame:
    """Mean and count per station, depth and day, of sensor means at each time.

    ``obs.ts`` is a timestamp; a day is final once the watermark, ``late`` behind the
    newest time seen, has passed its end.
    """
    masked = mask_flags(obs).filter(F.col(depth).isNotNull()).withWatermark("ts", late)
    times = masked.groupBy(*by, F.col(depth).alias("depth"), F.window("ts", "1 second").alias("at")).agg(F.avg("value").alias("value"))
    days = times.groupBy(*by, "depth", F.window(F.window_time("at"), "1 day").alias("w")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return days.select(*by, "depth", F.to_date("w.start").alias("day"), "value", "n")
