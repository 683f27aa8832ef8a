"""Gap filling from the month-day climatology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEYS


def fill_from_climatology(series: DataFrame, by: Sequence[str] = KEYS, flag: str = "value_qc", keep_flag: bool = True, per_depth: bool = False, aligned: bool = False) -> DataFrame:
    """Missing values become the mean of their calendar day over the given rows.

    If 29 February has no mean at any depth of the station, its mean is that of the 28th,
    or of 1 March where the 28th has none at any depth either; with ``per_depth`` each
    depth is judged alone. ``flag`` is 0 observed, 1 filled, 2 still missing; an existing
    flag column is kept if ``keep_flag``, and the new one gets the suffix ``_gapfill``.
    ``aligned``: the rows are already partitioned by ``by`` and need no exchange.
    """
    rows = (series if aligned else series.repartition(*by)).withColumn("md_", month_day())
    return _filled(rows.withColumn("clim_", F.avg("value").over(W.partitionBy(*by, "depth", "md_"))), by, flag, keep_flag, per_depth)


def month_day() -> Column:
    return F.date_format("day", "MM-dd")


def _filled(rows: DataFrame, by: Sequence[str], flag: str, keep_flag: bool, per_depth: bool) -> DataFrame:
    """Rows with the month-day ``md_`` and its mean ``clim_``, filled from it."""
    name = f"{flag}_gapfill" if flag in rows.columns and keep_flag else flag
    station, one = W.partitionBy(*by), W.partitionBy(*by, "depth")
    scope = one if per_depth else station
    on = lambda d: F.when(F.col("md_") == d, F.col("clim_"))
    known = lambda d: F.max(on(d)).over(scope).isNotNull()
    rows = rows.select("*", known("02-29").alias("k29_"), known("02-28").alias("k28_"), F.max(on("02-28")).over(one).alias("c28_"), F.max(on("03-01")).over(one).alias("c01_"))
    leap = (F.col("md_") == "02-29") & ~F.col("k29_")
    clim = F.when(leap & F.col("k28_"), F.col("c28_")).when(leap, F.col("c01_")).otherwise(F.col("clim_"))
    filled = F.coalesce("value", clim)
    state = F.when(F.col("value").isNotNull(), 0).when(filled.isNotNull(), 1).otherwise(2).cast("byte")
    return rows.withColumn(name, state).withColumn("value", filled).drop("md_", "clim_", "k29_", "k28_", "c28_", "c01_")


def climatology_sums(series: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, depth, md_, years): for each month-day its running sums and counts by year.

    ``years`` lists (year, total, n) over the values up to that year, one entry for each
    year that has any: as many as the record has years. The mean of a month-day within
    any window is a difference of two entries, so that new limits need no second scan.
    """
    value = F.col("value")
    each = series.filter(value.isNotNull()).groupBy(*by, "depth", month_day().alias("md_"), F.year("day").alias("year")).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    order = W.partitionBy(*by, "depth", "md_").orderBy("year")
    run = each.select(*by, "depth", "md_", F.struct("year", F.sum("s").over(order).alias("total"), F.sum("k").over(order).alias("n")).alias("y"))
    return run.groupBy(*by, "depth", "md_").agg(F.array_sort(F.collect_list("y")).alias("years"))


def fill_window(series: DataFrame, sums: DataFrame, windows: DataFrame, by: Sequence[str] = KEYS, flag: str = "value_qc", keep_flag: bool = True, per_depth: bool = False) -> DataFrame:
    """``series`` within each station's window, filled as by ``fill_from_climatology``.

    ``sums``: ``climatology_sums`` of the whole series; ``windows``: keys, start and end,
    both included, one row for each station; stations without one are left out. Equal to
    filling the rows of the window, but for the rounding of sums.
    """
    inside = series.join(windows, list(by)).filter(F.col("day").between(F.col("start"), F.col("end"))).withColumn("md_", month_day())
    rows = inside.join(sums, [*by, "depth", "md_"], "left")
    edge = lambda c: F.date_format(c, "MM-dd")
    last = F.year("end") - (F.col("md_") > edge("end")).cast("int")
    before = F.year("start") - (F.col("md_") >= edge("start")).cast("int")
    # the entry of the last year up to a given one; none before the first
    upto = lambda year: F.try_element_at(F.filter("years", lambda y: y["year"] <= year), F.lit(-1))
    rows = rows.withColumns({"z_": upto(last), "a_": upto(before)})
    part = lambda f: F.coalesce(F.col(f"z_.{f}"), F.lit(0)) - F.coalesce(F.col(f"a_.{f}"), F.lit(0))
    rows = rows.withColumn("clim_", F.when(part("n") > 0, part("total") / part("n")))
    return _filled(rows.drop("years", "z_", "a_", "start", "end"), by, flag, keep_flag, per_depth)
