"""The whole station job as one plan for all stations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS
from ..operators import depth, fill, gaps, qc, resample, station, trim
from ..session import written


@dataclass(frozen=True)
class Limits:
    min_obs: int = 6
    max_gap_days: int = 7
    min_frac: float = 0.95
    min_days: int = 365
    surface: str = "0-10"


@dataclass(frozen=True)
class StationJob:
    """Plans of the job's results; nothing runs before one is written or shown."""

    series: DataFrame
    runs: DataFrame
    trimmed: DataFrame
    filled: DataFrame
    status: DataFrame
    saved: DataFrame


def daily_bins(obs: DataFrame, limits: Limits = Limits(), by: Sequence[str] = KEYS) -> DataFrame:
    """Raw observations to the dense daily series of each depth bin."""
    days = resample.daily(resample.mean_by_depth(qc.mask_flags(obs), by), by)
    dense = resample.densify(resample.drop_empty_depths(days, by), by)
    return depth.mean_by_bin(depth.to_cm(resample.require_count(dense, limits.min_obs), by), by)


def daily_and_problems(obs: DataFrame, by: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Daily means by depth, and the lines that could not be read, from one pass over ``obs``.

    Unreadable rows, which have no time, are dealt to as many groups as readable ones by
    a hash of their place, so that a station full of them is no single group. Both
    results come from one written table of one row for each depth and day.
    """
    bad = F.col("problem").isNotNull()
    rows = qc.mask_flags(obs).filter(bad | F.col("depth_to").isNotNull()).select(
        *by, bad.alias("bad"), F.coalesce("depth_to", F.lit(0.0)).alias("depth"), F.coalesce(F.to_date("ts"), F.date_from_unix_date(F.pmod(F.xxhash64("file", "line"), F.lit(4096)).cast("int"))).alias("day"),
        "ts", F.when(~bad, F.col("value")).alias("value"), F.when(bad, F.struct("file", "line", "problem")).alias("place"),
    )
    keys = [*by, "bad", "depth", "day"]
    times = rows.repartition(*keys).groupBy(*keys, "ts").agg(F.avg("value").alias("value"), F.count("place").alias("n_bad"), F.min("place").alias("place"))
    held = written(times.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("value").alias("n"), F.sum("n_bad").alias("n_bad"), F.min("place").alias("place")))
    first = held.filter("bad").groupBy(*by).agg(F.sum("n_bad").alias("n_problems"), F.min("place").alias("place"))
    return held.filter("not bad").select(*by, "depth", "day", "value", "n"), first.select(*by, "n_problems", F.col("place.problem").alias("problem"))


def station_job(obs: DataFrame, stations: DataFrame, limits: Limits = Limits(), by: Sequence[str] = KEYS, hold: bool = False) -> StationJob:
    """The job's results as plans; ``hold`` writes the daily rows, which all of them read,
    once, so that raw observations are scanned once for however many results are used.

    ``obs`` with a column ``problem``, as archives are read, is always held: stations that
    have any are an ``error``, whatever their other lines give, and nothing of them is saved.
    """
    bad = None
    if "problem" in obs.columns:
        days, bad = daily_and_problems(obs, by)
    else:
        days = resample.daily(resample.mean_by_depth(qc.mask_flags(obs), by), by)
        days = written(days) if hold else days
    kept = resample.drop_empty_depths(days, by)
    # the deepest depth is reported in cm as if all depths were in metres, as before
    found = kept.groupBy(*by).agg(F.max("depth").alias("max_depth"))
    dense = resample.require_count(resample.densify(kept, by), limits.min_obs)
    series = depth.mean_by_bin(depth.to_cm(dense, by), by)
    # from here to the status every step is a window or a sum over the station's rows,
    # which the exchange of the daily rows has brought together
    marked = trim.mark_surface_window(series, limits.max_gap_days, limits.surface, by)
    trimmed = trim.inside_surface_window(marked, limits.min_frac, by)
    filled = fill.fill_from_climatology(trimmed, by, aligned=True)
    table = station.status(stations, found, marked, filled, by, limits.min_days, problems=bad)
    runs = gaps.longest_available_run(series, limits.max_gap_days, by)
    saved = filled.join(table.filter("status = 'saved'").select(*by, "filename"), list(by))
    return StationJob(series, runs, trimmed, filled, table, saved)
