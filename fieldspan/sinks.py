"""Writers of series and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import KEYS


def write_series(saved: DataFrame, path: str, by: Sequence[str] = KEYS, mode: str = "errorifexists") -> None:
    """Filled series, one folder per station; ``filename`` names the old file."""
    saved.repartition(*by).sortWithinPartitions(*by, "depth", "day").write.mode(mode).partitionBy(*by).parquet(path)


def flat(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Without ``drop``, and with arrays, maps and structs as JSON, as CSV needs."""
    kinds = (T.ArrayType, T.MapType, T.StructType)
    df = df.drop(*drop)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, drop: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """A CSV table with a header."""
    flat(df, drop).write.mode(mode).option("escape", "\"").csv(path, header=True)


def union_records(frames: Sequence[DataFrame]) -> DataFrame:
    """Records of different columns as one table; missing ones are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
