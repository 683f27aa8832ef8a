"""Files named by the data: a data source writer with commit and abort.

Tasks write under a hidden folder; only when all of them are done does the driver move
the files to their names, so that a failed job leaves nothing and a rerun replaces.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .model import KEYS
from .sources.archive import opened

FORMAT = "named_files"
#: The column that holds a file's name, with folders, below the path written to.
NAME = "file_name_"


@dataclass
class Files(WriterCommitMessage):
    """Where a task has put each file, and the name it is to get."""

    moves: list[tuple[str, str]]


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, options, schema):
        self.path, self.text = options["path"], options.get("as", "parquet") == "text"
        self.series = options.get("series") == "true"
        self.job = uuid.uuid4().hex
        if NAME not in schema.names or (self.text and sorted(schema.names) != sorted([NAME, "value"])):
            raise ValueError(f"needs the column {NAME}" + " and value" * self.text)

    def _hidden(self, root: str) -> str:
        return f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        system, root = opened(self.path)
        folder = f"{self._hidden(root)}/{uuid.uuid4().hex}"
        system.create_dir(folder)
        moves: list[tuple[str, str]] = []
        sink, name = None, None
        for batch in iterator:
            runs = pc.run_end_encode(batch.column(NAME))
            ends = runs.run_ends.to_pylist()
            for this, lo, hi in zip(runs.values.to_pylist(), [0, *ends[:-1]], ends, strict=True):
                if this != name or sink is None:
                    if sink is not None:
                        sink.close()
                    name = this
                    _check(name)
                    moves.append((f"{folder}/{len(moves)}", name))
                    rows = batch.schema.remove(batch.schema.get_field_index(NAME))
                    sink = system.open_output_stream(moves[-1][0]) if self.text else pq.ParquetWriter(moves[-1][0], rows, filesystem=system)
                part = batch.slice(lo, hi - lo).drop_columns([NAME])
                if self.text:
                    lines = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("value").cast(pa.string()).fill_null(""))
                    sink.write(pc.binary_join(lines, "\n")[0].as_buffer())
                    sink.write(b"\n")
                else:
                    sink.write_batch(part)
        if sink is not None:
            sink.close()
        return Files(moves)

    def commit(self, messages: list[Files | None]) -> None:
        """One move for each file; a name that two tasks wrote fails before any move."""
        system, root = opened(self.path)
        moves = [m for part in messages if part for m in part.moves]
        names = [n for _, n in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a file's rows lie apart: repartition and sort by name")
        if self.series:
            self._replace(system, root, names)
        for parent in {f"{root}/{n}".rsplit("/", 1)[0] for n in names}:
            system.create_dir(parent)
        for at, name in moves:
            system.move(at, f"{root}/{name}")
        self._clean(system, root)

    def _replace(self, system: fs.FileSystem, root: str, names: list[str]) -> None:
        """Older files of the same stations, whose dates may differ, go."""
        stem = lambda n: m[1] if (m := re.fullmatch(r"(.+)_\d{8}_\d{8}\.parquet", n)) else None
        new = {stem(n) for n in names} - {None}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.is_file and info.base_name not in names and stem(info.base_name) in new:
                system.delete_file(info.path)

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        system.delete_dir_contents(self._hidden(root), missing_dir_ok=True)
        for folder in (self._hidden(root), f"{root}/_temporary"):
            if not system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) and system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir(folder)

    def abort(self, messages: list[Files | None]) -> None:
        system, root = opened(self.path)
        self._clean(system, root)


def _check(name: str | None) -> None:
    if not name or name.startswith("/") or any(p in ("", ".", "..") or p.startswith("_") for p in name.split("/")):
        raise ValueError(f"no file name: {name!r}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options, schema)


def _write(df: DataFrame, path: str, **options: str) -> None:
    df.sparkSession.dataSource.register(NamedFiles)
    df.write.format(FORMAT).mode("append").options(**options).save(path)


def write_text_files(rows: DataFrame, path: str, name: str, value: str, order: Sequence[str]) -> None:
    """A text file for each ``name``, its lines in ``order``; a file of that name is replaced.

    A file is written by one task as its rows come, whatever its length.
    """
    rows = rows.select(F.col(name).alias(NAME), F.col(value).alias("value"), *[F.col(c).alias(f"o{i}_") for i, c in enumerate(order)])
    rows = rows.repartition(NAME).sortWithinPartitions(NAME, *[f"o{i}_" for i in range(len(order))])
    _write(rows.select(NAME, "value"), path, **{"as": "text"})


def write_station_files(saved: DataFrame, path: str, by: Sequence[str] = KEYS, flag: str = "value_qc") -> None:
    """Each station's series in ``<keys>_<first>_<last>.parquet``, days as yyyyMMdd.

    The days are the first and last observed ones, as the decision table counts them:
    ``flag`` 0, or any value where ``saved`` has no flag. An earlier file of the station
    goes, even if its days differ. Rows are exchanged once by station and sorted; a
    station without an observed day has no name and is left out.
    """
    seen = F.when(F.col(flag) == 0, F.col("day")) if flag in saved.columns else F.when(F.col("value").isNotNull(), F.col("day"))
    one = W.partitionBy(*by)
    day = lambda f: F.date_format(f(seen).over(one), "yyyyMMdd")
    rows = saved.withColumns({"first_": day(F.min), "last_": day(F.max)}).filter("first_ is not null")
    rows = rows.withColumn(NAME, F.concat(F.concat_ws("_", *by, "first_", "last_"), F.lit(".parquet"))).drop("first_", "last_")
    _write(rows.sortWithinPartitions(*by, "depth", "day"), path, series="true")
