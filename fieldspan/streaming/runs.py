"""Longest missing and available runs over a stream of daily rows.

The state of a series is the days that may still change, and of all days before them the
open runs, the best ones and the last day. It does not grow with the record.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..model import KEYS

#: What a series' state says of the days that are final; days count from 1970-01-01.
FIELDS = ("last", "gap_start", "gap", "run_start", "run", "best_gap", "best_gap_start", "best_run", "best_run_start")
RESULT = "missing_days long, missing_start date, missing_end date, run_days long, run_start date, run_end date, last_day date"
DAY_MS = 86_400_000


def advanced(state: dict | None, day: int, has_value: bool, max_gap: int) -> dict:
    """The state after one more day; days that were left out before it were missing.

    ``gap`` is the missing run that reaches the last day, ``run`` the available one
    before it. A gap of up to ``max_gap`` days joins the runs on both sides.
    """
    if state is None:
        state = dict.fromkeys(FIELDS, 0) | {"last": day - 1}
    s = dict(state)
    missing = day - s["last"] - has_value
    if missing:
        s["gap_start"] = s["gap_start"] if s["gap"] else s["last"] + 1
        s["gap"] += missing
        if s["gap"] > s["best_gap"]:
            s["best_gap"], s["best_gap_start"] = s["gap"], s["gap_start"]
    if s["gap"] > max_gap:
        s = _closed(s)
    if has_value:
        if s["gap"] and s["gap"] <= max_gap:
            s["run_start"] = s["run_start"] if s["run"] else s["gap_start"]
            s["run"] += s["gap"]
        s["run_start"] = s["run_start"] if s["run"] else day
        s["run"], s["gap"] = s["run"] + 1, 0
    s["last"] = day
    return s


def _closed(s: dict) -> dict:
    """Without an open run; the first of equal ones stays the best."""
    if s["run"] > s["best_run"]:
        s = s | {"best_run": s["run"], "best_run_start": s["run_start"]}
    return s | {"run": 0}


def result(s: dict, max_gap: int) -> list:
    """The longest runs as if the record ended here: a short gap at its end counts as available."""
    if 0 < s["gap"] <= max_gap:
        s = s | {"run": s["run"] + s["gap"], "run_start": s["run_start"] if s["run"] else s["gap_start"]}
    s = _closed(s)
    on = lambda n: date(1970, 1, 1) + timedelta(days=n)
    ends = lambda n, start: [n, on(start) if n else None, on(start + n - 1) if n else None]
    return [*ends(s["best_gap"], s["best_gap_start"]), *ends(s["best_run"], s["best_run_start"]), on(s["last"])]


class Runs(StatefulProcessor):
    def __init__(self, keys: list[str], columns: list[str], max_gap: int):
        self.keys, self.columns, self.max_gap = keys, columns, max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", ", ".join(f"{f} long" for f in FIELDS))
        self.open = handle.getMapState("open", "day long", "has_value boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.settled.get()[0] if self.settled.exists() else None
        seen: dict[int, bool] = {}
        for pdf in rows:
            for day, has in zip(pdf["day_"].tolist(), pdf["has_"].tolist(), strict=True):
                if first is None or day > first:
                    seen[day] = seen.get(day, False) or has
        for day, has in seen.items():
            had = self.open.getValue((day,))[0] if self.open.containsKey((day,)) else False
            self.open.updateValue((day,), (has or had,))
        if seen:
            self.handle.registerTimer(max(seen) * DAY_MS)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs()
        state = dict(zip(FIELDS, self.settled.get(), strict=True)) if self.settled.exists() else None
        days = sorted((k[0], v[0]) for k, v in self.open.iterator() if k[0] * DAY_MS <= final)
        for day, has in days:
            state = advanced(state, day, has, self.max_gap)
            self.open.removeKey((day,))
        if days:
            self.settled.update(tuple(state[f] for f in FIELDS))
            yield pd.DataFrame([[*key, *result(state, self.max_gap)]], columns=self.columns)
        else:
            yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def run_stream(days: DataFrame, max_gap_days: int = 7, late: str = "30 days", by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, depth, the longest missing and available run, last_day), updated as days become final.

    ``days``: a stream of (keys, depth, day, value). A day is final once the watermark,
    ``late`` behind the newest day of the whole stream, has reached it; until then its
    rows come in any order, and it has a value if any of them has. Rows of final days
    count for nothing. Days that never come are missing, from the first day of a series
    to its last. The last row of a series is what ``longest_missing_run`` and
    ``longest_available_run`` give for its final days. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    keys = [*by, "depth"]
    kinds = [T.StructField(k, days.schema[k].dataType) for k in keys]
    schema = T.StructType([*kinds, *T.StructType.fromDDL(RESULT).fields])
    has = F.col("value").isNotNull() & ~F.isnan("value")
    rows = days.filter(F.col("day").isNotNull()).select(*keys, F.unix_date("day").cast("long").alias("day_"), has.alias("has_"), F.col("day").cast("timestamp").alias("at_")).withWatermark("at_", late)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=Runs(keys, schema.names, max_gap_days), outputStructType=schema, outputMode="Update", timeMode="EventTime")
