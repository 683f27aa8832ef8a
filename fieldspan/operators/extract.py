"""Sensor depths and heights from the text of reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a sensor row, a code, a triple and the heights look like.
SENSOR_ROW = r"(-?\d+\.?\d*)\s+(-?\d+\.?\d*)\s+(-?\d+\.?\d*)\s+(SWC|TS)_\d+_\d+_\d+\s*$"
CODE = r"(SWC|TS)_\d+_\d+_\d+"
TRIPLE = r"(?:(?<=\s)|^)(-?\d+\.?\d*)\s+(-?\d+\.?\d*)\s+(-?\d+\.?\d*)"
HEIGHT = r"HEIGHT\s*\(m\)\s+([\d.]+)"
CANOPY = r"(?i)(?:canopy|tree|vegetation|stand)\s+height[^0-9]*?([\d.]+)\s*m"
#: What ends a line, beside a line feed.
BREAKS = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
DEEPEST, SHALLOWEST = -3.0, -0.001


def split_lines(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("SITE_ID",)) -> DataFrame:
    """(keys, line_no, line); an ending line break makes no further line."""
    parts = F.split(F.col(text), BREAKS)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return docs.select(*keep, F.posexplode(parts).alias("line_no", "line"))


def _group(col: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, i), F.lit(""))


def first_depth(line: Column) -> Column:
    """The first number in range that begins a group of three numbers."""
    found = F.transform(F.regexp_extract_all(line, F.lit(TRIPLE), F.lit(1)), lambda x: x.try_cast("double"))
    return F.element_at(F.concat(F.filter(found, lambda d: d.between(DEEPEST, SHALLOWEST)), F.array(F.lit(None).cast("double"))), 1)


def line_facts(lines: DataFrame, by: Sequence[str] = ("SITE_ID",), before: int = 1, after: int = 2) -> DataFrame:
    """``lines`` plus swc, ts (depths), height and canopy found on each.

    A sensor row carries its depth, which for TS must be negative. A code without one
    takes the first depth of the lines around it: one before, itself, two after.
    """
    line = F.col("line")
    order = W.partitionBy(*by).orderBy("line_no")
    df = lines.select("*", _group(line, SENSOR_ROW, 4).alias("row_kind"), _group(line, SENSOR_ROW, 1).try_cast("double").alias("row_depth"), _group(line, CODE, 1).alias("code"), first_depth(line).alias("own"))
    near = F.coalesce(*[F.lag("own", -d).over(order) if d else F.col("own") for d in range(-before, after + 1)])
    kind = F.coalesce("row_kind", "code")
    depth = F.when(F.col("row_kind") == "SWC", F.col("row_depth")).when(F.col("row_kind") == "TS", F.when(F.col("row_depth") < 0, F.col("row_depth"))).otherwise(near)
    df = df.select("*", kind.alias("kind"), depth.alias("depth"))
    # a captured lone dot is no number; the first match of a line stands for the line
    return df.select(*by, "line_no", "line", F.when(F.col("kind") == "SWC", F.col("depth")).alias("swc"), F.when(F.col("kind") == "TS", F.col("depth")).alias("ts"), _group(line, HEIGHT, 1).try_cast("double").alias("height"), _group(line, CANOPY, 1).try_cast("double").alias("canopy"))


def report_facts(docs: DataFrame, text: str = "text", by: Sequence[str] = ("SITE_ID",)) -> DataFrame:
    """One row per report: sorted distinct depths and the first height of each kind.

    A report without text gets an ERROR and empty lists.
    """
    facts = line_facts(split_lines(docs.filter(F.trim(F.col(text)) != ""), text, by), by)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    found = facts.groupBy(*by).agg(F.array_sort(F.collect_set("swc")).alias("SWC_DEPTHS_M"), F.array_sort(F.collect_set("ts")).alias("TS_DEPTHS_M"), first("height").alias("MEASUREMENT_HEIGHT_M"), first("canopy").alias("CANOPY_HEIGHT_M"))
    out = docs.select(*by, (F.coalesce(F.trim(F.col(text)), F.lit("")) == "").alias("blank")).join(found, list(by), "left")
    none = F.array().cast("array<double>")
    return out.select(*by, F.coalesce("SWC_DEPTHS_M", none).alias("SWC_DEPTHS_M"), F.coalesce("TS_DEPTHS_M", none).alias("TS_DEPTHS_M"), "MEASUREMENT_HEIGHT_M", "CANOPY_HEIGHT_M", F.when(F.col("blank"), "empty text").alias("ERROR"))


def outcome(reports: DataFrame) -> DataFrame:
    """How many reports gave facts and how many an error."""
    return reports.agg(F.count_if(F.col("ERROR").isNull()).alias("n_ok"), F.count_if(F.col("ERROR").isNotNull()).alias("n_error"))
