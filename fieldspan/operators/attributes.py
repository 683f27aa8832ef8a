"""Entity-attribute-value metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ("SITE_ID", "VARIABLE_GROUP", "GROUP_ID")


def pivot_groups(rows: DataFrame, variables: Sequence[str], by: Sequence[str] = GROUP, variable: str = "VARIABLE", value: str = "DATAVALUE", order: str = "ord") -> DataFrame:
    """One row per group with a column per variable; of repeats the last by ``order``."""
    wanted = rows.filter(F.col(variable).isin(list(variables)))
    pick = lambda v: F.max_by(value, F.when(F.col(variable) == v, F.col(order)))
    return wanted.groupBy(*by).agg(*[F.when(F.count_if(F.col(variable) == v) > 0, pick(v)).alias(v) for v in variables])


def group_maps(rows: DataFrame, by: Sequence[str] = GROUP, variable: str = "VARIABLE", value: str = "DATAVALUE", order: str = "ord") -> DataFrame:
    """One row per group with a map of all its variables, whichever they are.

    Of repeats of a variable the last by ``order`` stays, a NULL value too; rows without
    a variable are left out. The first exchange is by group and variable, so that a group
    of many repeats is added up in parts; a group's map holds each variable once.
    """
    last = rows.filter(F.col(variable).isNotNull()).groupBy(*by, variable).agg(F.max_by(value, order).alias("last_"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(variable, "last_")))).alias("variables"))


def whole(text: Column) -> Column:
    """A number's whole part, cut toward zero; NULL for text that is no finite number."""
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 9e18), x.try_cast("long"))


def depth_ranges(groups: DataFrame, lo: str, hi: str, by: Sequence[str] = ("SITE_ID",)) -> DataFrame:
    """Sorted distinct ``MIN-MAX`` ranges of each key, by the number before the dash."""
    pair = F.struct(whole(F.col(lo)).alias("a"), whole(F.col(hi)).alias("b"))
    ok = F.when(whole(F.col(lo)).isNotNull() & whole(F.col(hi)).isNotNull(), pair)
    out = groups.groupBy(*by).agg(F.array_sort(F.collect_set(ok)).alias("r"))
    return out.select(*by, F.transform("r", lambda p: F.concat(p["a"].cast("string"), F.lit("-"), p["b"].cast("string"))).alias("ranges"))


def latest_mean(groups: DataFrame, value: str, statistic: str, date: str, extra: Sequence[str] = (), by: Sequence[str] = ("SITE_ID",), order: str = "ord") -> DataFrame:
    """The entry of latest date among those whose statistic is ``mean`` in any case.

    A date that is no number counts as 0; of equal dates the first by ``order`` stays.
    """
    means = groups.filter((F.lower(statistic) == "mean") & F.col(value).isNotNull())
    rank = F.struct(F.coalesce(F.col(date).try_cast("bigint"), F.lit(0).cast("bigint")), -F.col(order))
    best = means.groupBy(*by).agg(F.max_by(F.struct(value, date, *extra), rank).alias("e"))
    return best.select(*by, F.col(f"e.{value}").try_cast("double").alias(value), *[F.col(f"e.{c}").alias(c) for c in (date, *extra)])
