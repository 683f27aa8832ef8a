"""Schemas and the rule for missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("network", "station")

OBSERVATIONS = T.StructType([
    T.StructField("network", T.StringType()),
    T.StructField("station", T.StringType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("depth_to", T.DoubleType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("flag", T.StringType()),
])

STATIONS = T.StructType([
    T.StructField("network", T.StringType()),
    T.StructField("station", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

ATTRIBUTES = T.StructType([T.StructField(c, T.StringType()) for c in ("SITE_ID", "GROUP_ID", "VARIABLE_GROUP", "VARIABLE", "DATAVALUE")])

#: What data files write for a missing number.
MISSING = -9999.0


def null_if_nan(col: Column) -> Column:
    """NaN as NULL: Spark orders NaN above all numbers, so no NaN may go on."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def number(col: Column) -> Column:
    """A number from any text; NULL for what is none or NaN."""
    return null_if_nan(col.try_cast("double"))


def coerced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of ``columns`` that exist, as numbers."""
    return df.withColumns({c: number(F.col(c)) for c in columns if c in df.columns})


def without_missing(df: DataFrame) -> DataFrame:
    """-9999 as NULL: in numbers every spelling, in text ``-9999`` and ``-9999.0``."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.nullif(null_if_nan(F.col(f"`{f.name}`")), F.lit(MISSING))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            out[f.name] = F.nullif(F.col(f"`{f.name}`"), F.lit(int(MISSING)))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(~F.trim(f"`{f.name}`").isin("-9999", "-9999.0"), F.col(f"`{f.name}`"))
    return df.withColumns(out)
