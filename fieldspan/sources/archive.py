"""Station archives as a data source: planned by folder and size, pruned before it is read.

``<network>/<station>/<sensor>…<variable>_<depth from>_<depth to>….stm``, in two layouts:
a header line with the coordinates, then ``yyyy/MM/dd HH:mm value flag``; or rows that
carry everything, ``date time date time list network station latitude longitude elevation
from to value flag``. Lines that are neither stay in the result beside the good ones, with
what is wrong with them in ``problem``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "station_archive"
SCHEMA = """network string, station string, sensor string, variable string, depth_from double, depth_to double, ts timestamp_ntz, value double, flag string,
    latitude double, longitude double, file string, line long, problem string"""
STATIONS = "network string, station string, latitude double, longitude double"
#: Bytes of a file held at once.
BLOCK = 1 << 20
#: Bytes of files after which a partition ends.
SPLIT = 16 << 20

# The names of files and the two layouts of lines.
FILE = re.compile(r"(?:^|_)([A-Za-z]+)_(-?\d+\.\d+)_(-?\d+\.\d+)")
_DAY, _TIME, _NUMBER = r"\d{4}/\d{2}/\d{2}", r"\d{2}:\d{2}", r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
NUMBER = re.compile(_NUMBER)
SHORT = rf"^\s*(?P<day>{_DAY})\s+(?P<time>{_TIME})\s+(?P<value>{_NUMBER}|[Nn]a[Nn])(?:\s+(?P<flag>\S+)(?:\s+\S+)?)?\s*$"
LONG = rf"^\s*(?P<day>{_DAY})\s+(?P<time>{_TIME})\s+{_DAY}\s+{_TIME}\s+\S+\s+\S+\s+\S+\s+(?P<lat>{_NUMBER})\s+(?P<lon>{_NUMBER})\s+{_NUMBER}\s+(?P<low>{_NUMBER})\s+(?P<high>{_NUMBER})\s+(?P<value>{_NUMBER}|[Nn]a[Nn])(?:\s+(?P<flag>\S+)(?:\s+\S+)?)?\s*$"
_IS_LONG, _IS_SHORT = re.compile(LONG), re.compile(SHORT)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address or of a local path, and the path on it."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


@dataclass
class Folder(InputPartition):
    """One station, or a part: its folder's files that may hold what is asked for."""

    network: str
    station: str
    files: list[str]


def depths(name: str) -> tuple[str | None, float | None, float | None]:
    """Variable and depths in a file's name."""
    found = FILE.search(name)
    return (found[1], float(found[2]), float(found[3])) if found else (None, None, None)


class ArchiveReader(DataSourceReader):
    """``wanted``: names of networks and stations, which choose folders, and of variables
    and least and greatest depth_to, which choose files. A file whose name tells neither
    is read whatever is wanted.
    """

    def __init__(self, path: str, stations: bool, wanted: dict):
        self.path, self.stations, self.wanted = path, stations, wanted

    def _may_hold(self, name: str) -> bool:
        variable, _, to = depths(name)
        variables, (least, most) = self.wanted.get("variable"), self.wanted.get("depth", (None, None))
        if variable is None:
            return True
        return (variables is None or variable in variables) and (least is None or to >= least) and (most is None or to <= most)

    def _inside(self, system: fs.FileSystem, path: str, column: str | None) -> list:
        found = sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path)
        if column is None:
            return [i for i in found if i.is_file and i.base_name.endswith(".stm")]
        wanted = self.wanted.get(column)
        return [i for i in found if i.type == fs.FileType.Directory and (wanted is None or i.base_name in wanted)]

    def partitions(self) -> list[Folder]:
        system, root = opened(self.path)
        out = []
        for net in self._inside(system, root, "network"):
            for sta in self._inside(system, net.path, "station"):
                held = 0
                for i in self._inside(system, sta.path, None):
                    if not self._may_hold(i.base_name):
                        continue
                    # first lines do not grow with their files: a station's stay together
                    if not held or (held >= SPLIT and not self.stations):
                        out.append(Folder(net.base_name, sta.base_name, []))
                        held = 0
                    out[-1].files.append(i.path)
                    held += max(i.size, 1)
        return out or [Folder("", "", [])]  # no partition would not do

    def read(self, partition: Folder) -> Iterator:
        system, _ = opened(self.path)
        if self.stations:
            yield from self._station(system, partition)
            return
        for path in partition.files:
            try:
                yield from _rows(system, path, partition)
            except (OSError, pa.ArrowException) as e:
                yield _batch(partition, path, [0], problem=[f"{path.rsplit('/', 1)[-1]}: {type(e).__name__}"])

    def _station(self, system: fs.FileSystem, folder: Folder) -> Iterator[tuple]:
        if not folder.files:
            return
        for path in folder.files:
            try:
                with system.open_input_stream(path) as f:
                    place = _place(f.read(4096).decode(errors="replace").split("\n", 1)[0], path.rsplit("/", 1)[-1])
            except OSError:
                continue
            if place:
                yield folder.network, folder.station, *place
                return
        yield folder.network, folder.station, None, None


def _header(line: str, name: str) -> tuple[float, ...] | None:
    """Latitude, longitude, depth from and depth to in a header line.

    They stand beside the elevation as five numbers in a row. Names may be numbers too:
    of several such rows the last counts whose depths are those of the file's name, or
    that can be coordinates.
    """
    words, known = line.split(), depths(name)[1:]
    for i in range(len(words) - 5, -1, -1):
        five = words[i : i + 5]
        if all(map(NUMBER.fullmatch, five)):
            lat, lon, _, low, high = map(float, five)
            if abs(lat) <= 90 and abs(lon) <= 180 and (known[0] is None or (low, high) == known):
                return lat, lon, low, high
    return None


def _place(line: str, name: str) -> tuple[float, float] | None:
    """Coordinates in the first line of a file of either layout."""
    if found := _IS_LONG.match(line):
        return float(found["lat"]), float(found["lon"])
    if not _IS_SHORT.match(line) and (found := _header(line, name)):
        return found[:2]
    return None


def _batch(folder: Folder, path: str, line, **columns) -> pa.RecordBatch:
    """Rows of a file; columns left out are NULL."""
    n, name = len(line), path.rsplit("/", 1)[-1]
    variable, low, high = depths(name)
    text, number = pa.string(), pa.float64()
    kinds = {"network": text, "station": text, "sensor": text, "variable": text, "depth_from": number, "depth_to": number, "ts": pa.timestamp("us"), "value": number, "flag": text, "latitude": number, "longitude": number, "file": text, "line": pa.int64(), "problem": text}
    same = {"network": folder.network, "station": folder.station, "sensor": re.sub(r"\.[^.]*$", "", name), "variable": variable, "depth_from": low, "depth_to": high, "file": name}
    if high is None:
        same = {k: v for k, v in same.items() if not k.startswith("depth")}
    out = {"line": line} | columns | {k: pa.repeat(pa.scalar(v, kinds[k]), n) for k, v in same.items()}
    return pa.record_batch([pa.nulls(n, k) if out.get(c) is None else pa.array(out[c], k) if isinstance(out[c], list) else out[c].cast(k) for c, k in kinds.items()], names=list(kinds))


def _blocks(f) -> Iterator[str]:
    """Whole lines of a file, some BLOCK bytes at a time."""
    rest = b""
    while chunk := f.read(BLOCK):
        at = chunk.rfind(b"\n") + 1
        if at:
            yield (rest + chunk[:at]).decode(errors="replace")
            rest = chunk[at:]
        else:
            rest += chunk
    if rest:
        yield rest.decode(errors="replace")


def _rows(system: fs.FileSystem, path: str, folder: Folder) -> Iterator[pa.RecordBatch]:
    done, pattern, place, name = 0, None, None, path.rsplit("/", 1)[-1]
    header = (None, None)
    with system.open_input_stream(path) as f:
        for block in _blocks(f):
            lines = block.removesuffix("\n").split("\n")
            numbers = pa.array(range(done + 1, done + len(lines) + 1), pa.int64())
            first, done = done == 0, done + len(lines)
            if first:
                place = _place(lines[0], name)
                pattern = LONG if _IS_LONG.match(lines[0]) else SHORT
                head = None if _IS_LONG.match(lines[0]) or _IS_SHORT.match(lines[0]) else _header(lines[0], name)
                if head:
                    lines, numbers, header = lines[1:], numbers[1:], head[2:]
            texts = pa.array(lines, pa.string())
            held = pc.not_equal(pc.utf8_trim_whitespace(texts), "")
            texts, numbers = texts.filter(held), numbers.filter(held)
            if len(texts):
                yield _parsed(texts, numbers, pattern, place, header, folder, path)
    if not done:
        yield _batch(folder, path, [0], problem=[f"{name}: empty file"])


def _parsed(texts: pa.Array, numbers: pa.Array, pattern: str, place, header, folder: Folder, path: str) -> pa.RecordBatch:
    name = path.rsplit("/", 1)[-1]
    found = pc.extract_regex(texts, pattern)
    get = lambda k: pc.struct_field(found, k)
    at = pc.binary_join_element_wise(get("day"), get("time"), " ")
    ts = pc.strptime(at, format="%Y/%m/%d %H:%M", unit="us", error_is_null=True)
    # a day that no month has comes back as another
    ts = pc.if_else(pc.equal(pc.strftime(ts, format="%Y/%m/%d %H:%M"), at), ts, pa.scalar(None, ts.type))
    bad = pc.is_null(ts)
    if pattern == LONG:
        number = lambda k: pc.cast(get(k), pa.float64())
        more = {"latitude": number("lat"), "longitude": number("lon"), "depth_from": number("low"), "depth_to": number("high")}
    else:
        fixed = {"latitude": place[0] if place else None, "longitude": place[1] if place else None, "depth_from": header[0], "depth_to": header[1]}
        more = {k: pa.repeat(pa.scalar(v, pa.float64()), len(texts)) for k, v in fixed.items()}
    flag = pc.if_else(pc.equal(get("flag"), ""), pa.scalar(None, pa.string()), get("flag"))
    what = pc.binary_join_element_wise(name, pc.cast(numbers, pa.string()), pc.utf8_slice_codeunits(texts, 0, 80), ":")
    return _batch(folder, path, numbers, ts=ts, value=pc.if_else(bad, pa.scalar(None, pa.float64()), pc.cast(get("value"), pa.float64())), flag=pc.if_else(bad, pa.scalar(None, pa.string()), flag), problem=pc.if_else(bad, what, pa.scalar(None, pa.string())), **more)


class StationArchive(DataSource):
    """``spark.read.format("station_archive").load(path)``; options: ``table``, which is rows
    or stations, and ``wanted`` as JSON, see ``ArchiveReader``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _stations(self) -> bool:
        table = self.options.get("table", "rows")
        if table not in ("rows", "stations"):
            raise ValueError(f"no table {table}")
        return table == "stations"

    def schema(self) -> str:
        return STATIONS if self._stations() else SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self._stations(), json.loads(self.options.get("wanted", "{}")))


def _load(spark: SparkSession, path: str, table: str, **wanted) -> DataFrame:
    # what is wanted goes in as an option of this one load. Filters that Spark pushes into
    # a Python source would do, but one use of a DataFrame then leaves them to all others.
    spark.dataSource.register(StationArchive)
    some = {k: list(v) for k, v in wanted.items() if v is not None}
    return spark.read.format(FORMAT).option("table", table).option("wanted", json.dumps(some)).load(path)


def read_archive(spark: SparkSession, path: str, network: Sequence[str] | None = None, station: Sequence[str] | None = None, variable: Sequence[str] | None = None, depth: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Every line of an archive but headers and blanks, as ``SCHEMA`` has it.

    Only folders of the networks and stations given are listed, and only files opened
    whose name has one of the variables and a depth_to between both ends of ``depth``,
    either of which may be None; files that do not tell are opened, and their rows that
    do not fit left out. A line that cannot be read has NULL for its time, value and flag,
    and file, number and text in ``problem``; so has one row for an empty file or one
    that cannot be opened. Depths come from the file's name, or else from its lines.
    """
    rows = _load(spark, path, "rows", network=network, station=station, variable=variable, depth=depth)
    if variable is not None:
        rows = rows.filter(F.col("variable").isin(list(variable)))
    for end, fits in zip(depth or (), (F.col("depth_to").__ge__, F.col("depth_to").__le__), strict=False):
        rows = rows if end is None else rows.filter(fits(end))
    return rows


def read_archive_stations(spark: SparkSession, path: str, network: Sequence[str] | None = None, station: Sequence[str] | None = None) -> DataFrame:
    """(network, station, latitude, longitude) of every station folder with files.

    Only first lines are read; coordinates that none of them has are NULL.
    """
    return _load(spark, path, "stations", network=network, station=station)


def problems(rows: DataFrame, by=("network", "station")) -> DataFrame:
    """(keys, n_problems, problem): number and first of the lines that cannot be read."""
    at = F.when(F.col("problem").isNotNull(), F.struct("file", "line"))
    return rows.groupBy(*by).agg(F.count("problem").alias("n_problems"), F.min_by("problem", at).alias("problem")).filter("n_problems > 0")
