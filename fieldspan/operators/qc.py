"""Quality flags of raw observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import null_if_nan


def good(flag: Column) -> Column:
    """Good data is flagged ``G`` or with any flag that starts with ``D``."""
    return (flag == "G") | flag.startswith("D")


def mask_flags(obs: DataFrame, value: str = "value", flag: str = "flag") -> DataFrame:
    """Values of other flags become NULL; their rows stay, as they span the record."""
    return obs.withColumn(value, F.when(good(F.col(flag)), null_if_nan(F.col(value))))
