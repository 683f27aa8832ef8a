"""Readers of measurement files and their listings."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import OBSERVATIONS, without_missing
from ..session import written
from .archive import opened

#: Characters of text in a batch of lines.
BATCH_BYTES = 1 << 20
RESOLUTIONS = ("HH", "DD", "WW", "MM", "YY")


def digits_to_time(col: Column) -> Column:
    """A time from its digits, by their number: year, month, day, minute or second."""
    s = F.trim(col.cast("string"))
    at = lambda pad, pattern: F.try_to_timestamp(F.concat(s, F.lit(pad)), F.lit(pattern)).cast("timestamp_ntz")
    n = F.length(s)
    return F.when(~s.rlike("^[0-9]+$"), None).when(n == 4, at("0101", "yyyyMMdd")).when(n == 6, at("01", "yyyyMMdd")).when(n == 8, at("", "yyyyMMdd")).when(n == 12, at("", "yyyyMMddHHmm")).when(n == 14, at("", "yyyyMMddHHmmss"))


def parse_time(col: Column) -> Column:
    """As digits, or as a date with an optional time."""
    return F.coalesce(digits_to_time(col), F.try_to_timestamp(col.cast("string")).cast("timestamp_ntz"))


#: Dates by name, in the order that decides between equal votes: month before day. A time
#: may follow each but the digits, which tell their own.
DATES = ("digits", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "dd-MMM-yyyy")
#: Dates that one text can be in two ways.
EITHER = ("MM/dd/yyyy", "dd/MM/yyyy")


def date_as(col: Column, name: str) -> Column:
    """A time read by one of ``DATES``, with or without hours, minutes and seconds."""
    if name == "digits":
        return digits_to_time(col)
    s = F.regexp_replace(F.regexp_replace(F.trim(col.cast("string")), "T", " "), "Z$", "")
    day = name.replace("MM/", "M/").replace("dd", "d").replace("/MM/", "/M/") if name in (*EITHER, "dd.MM.yyyy", "dd-MMM-yyyy") else name
    mark = next(c for c in "-/." if c in name)
    # a text without the format's marks cannot be read by it; trying would cost far more
    parts = F.when(s.contains(mark), F.length(s) - F.length(F.replace(s, F.lit(":"))))
    at = lambda time: F.try_to_timestamp(s, F.lit(day + time)).cast("timestamp_ntz")
    return F.when(parts == 0, at("")).when(parts == 1, at(" HH:mm")).when(parts == 2, at(" HH:mm:ss"))


def date_votes(rows: DataFrame, column: str, by: str = "file") -> DataFrame:
    """(by, n, format, n_parsed, ambiguous) of each file: how its dates are written.

    The format that reads most of the file's values; of equal ones the first of ``DATES``.
    ``ambiguous``: day before month and month before day read equally many, and some of
    them differently. A file without values has no format.
    """
    read = {name: date_as(F.col(column), name) for name in DATES}
    counts = [F.count(c).alias(f"v{i}_") for i, c in enumerate(read.values())]
    differ = F.count_if(read[EITHER[0]] != read[EITHER[1]]).alias("differ_")
    votes = rows.groupBy(by).agg(F.count(column).alias("n"), *counts, differ)
    best = F.greatest(*[f"v{i}_" for i in range(len(DATES))])
    name = F.coalesce(*[F.when(F.col(f"v{i}_") == best, n) for i, n in enumerate(DATES)])
    m, d = (F.col(f"v{DATES.index(n)}_") for n in EITHER)
    return votes.select(by, "n", F.when(best > 0, name).alias("format"), best.alias("n_parsed"), ((m == best) & (d == best) & (best > 0) & (F.col("differ_") > 0)).alias("ambiguous"))


def dates_by_vote(rows: DataFrame, column: str, by: str = "file") -> DataFrame:
    """``rows`` with the times of ``column``, each file read by its own format throughout.

    What that format cannot read is NULL.
    """
    chosen = date_votes(rows, column, by).select(by, F.col("format").alias("format_"))
    time = F.coalesce(*[F.when(F.col("format_") == n, date_as(F.col(column), n)) for n in DATES])
    return rows.join(chosen, by, "left").withColumn(column, time).drop("format_")


def _header(line: str) -> list[str]:
    """Names of a header line; of repeats the second is ``name.1``, and so on."""
    import csv

    out: list[str] = []
    for c in next(csv.reader([line.removeprefix("\ufeff")]), []):
        name, k = c.strip(), 0
        while (name if not k else f"{name}.{k}") in out:
            k += 1
        out.append(name if not k else f"{name}.{k}")
    return out


def _table(spark: SparkSession, path: str, texts: tuple[str, ...], comment: str | None = None) -> DataFrame:
    """Comma-separated files of a folder as one table; see ``_by_header``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    if comment:
        lines = lines.withColumn("value", F.regexp_replace("value", f"{comment}.*$", ""))
    lines = lines.filter(F.trim("value") != "")
    first = lines.withColumn("row", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", F.struct("at", "row")).alias("header"))
    return _by_header(spark, lines, first, texts)


def _by_header(spark: SparkSession, lines: DataFrame, first: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """Lines (file, value) of many files as one table, each by its own header (file, header).

    Columns are those of all headers, by name; a file without one has NULL there. Columns
    not in ``texts`` whose values are all numbers are numbers. The column ``file`` comes
    first. Lines equal to their file's header are headers, wherever they stand.
    """
    first = written(first)  # one row for each file
    # the kinds of header are few; their names are the schema, which the driver needs
    kinds = sorted(r[0] for r in first.select("header").distinct().collect())
    if not kinds:
        return spark.createDataFrame([], "file string, TIMESTAMP string")
    heads = [_header(h) for h in kinds]
    names = list(dict.fromkeys(n for h in sorted(heads, key=len, reverse=True) for n in h if n))
    if "file" in names:
        raise ValueError("a column is named file")
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("header")).cast("int")
    widest = ", ".join(f"c{i} string" for i in range(max(map(len, heads))))
    rows = lines.select("file", "value").join(first, "file").filter(F.col("value") != F.col("header")).select("file", kind.alias("kind"), F.from_csv("value", widest).alias("r"))
    rows = rows.select("file", "kind", F.array("r.*").alias("v"))
    place = lambda n: F.element_at(F.array(*[F.lit(h.index(n) if n in h else -1) for h in heads]), F.col("kind"))
    rows = without_missing(rows.select("file", *[F.nullif(F.trim(F.get("v", place(n))), F.lit("")).alias(n) for n in names]))
    quoted = {n: F.col(f"`{n}`") for n in names}
    odd = rows.agg(*[F.count_if(c.isNotNull() & c.try_cast("double").isNull()).alias(n) for n, c in quoted.items()]).first()
    return without_missing(rows.select("file", *[c if n in texts or odd[n] else c.try_cast("double").alias(n) for n, c in quoted.items()]))


def read_tower_csv(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """Comma-separated records, -9999 missing, timestamps parsed and in order.

    Files of a folder may have different columns, in any order; see ``_table``.
    """
    times = ("TIMESTAMP", "TIMESTAMP_START", "TIMESTAMP_END")
    df = _table(spark, path, times)
    key = next((c for c in times[:2] if c in df.columns), None)
    df = df.withColumns({c: digits_to_time(F.col(c)) for c in times if c in df.columns})
    df = df if with_file else df.drop("file")
    return df.orderBy(key) if key else df


def read_station_csv(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """The same with ``#`` comments, which may begin inside a line, and dates by vote.

    How dates are written is voted on in each file; ``station_dates`` reports the votes.
    """
    df = _table(spark, path, TIMES, "#")
    key = next((c for c in TIMES if c in df.columns), None)
    df = dates_by_vote(df, key) if key else df
    df = df if with_file else df.drop("file")
    return df.orderBy(key) if key else df


def station_dates(spark: SparkSession, path: str) -> DataFrame:
    """How each file that ``read_station_csv`` reads writes its dates, as ``date_votes`` has it."""
    df = _table(spark, path, TIMES, "#")
    return date_votes(df, next(c for c in TIMES if c in df.columns))


#: Columns of times, the first of which there is.
TIMES = ("TIMESTAMP", "Date", "date")


def resolution(name: Column) -> Column:
    """The first part of a file name that is a resolution, else ``OTHER``."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.try_element_at(F.filter(F.split(stem, "_"), lambda p: p.isin(*RESOLUTIONS)), F.lit(1)), F.lit("OTHER"))


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Listed ``.csv`` files with their ``resolution``."""
    return files.filter(F.col(path).endswith(".csv")).withColumn("resolution", resolution(F.col(path)))


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "modificationTime", "length")


def zip_members(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(archive, name, length) of the members of zip files below ``path`` that match ``pattern``."""
    import fnmatch
    import zipfile

    def run(batches):
        for batch in batches:
            for archive in batch.column("path").to_pylist():
                system, at = opened(archive)
                with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    found = [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, pattern)]
                if found:
                    names, sizes = zip(*found, strict=True)
                    yield pa.record_batch([pa.repeat(archive, len(names)), pa.array(names), pa.array(sizes, pa.int64())], names=["archive", "name", "length"])

    return list_files(spark, path, "*.zip").select("path").mapInArrow(run, "archive string, name string, length long")


def zip_lines(members: DataFrame, first_only: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(archive, name, line, value): the lines of each member, numbered from 1.

    Members are dealt over tasks, and inflated as they are read: a task holds one batch
    of ``batch_bytes`` and no member whole. ``first_only`` stops after the first line
    that is not blank. Bytes that are no UTF-8 become the replacement character.
    """
    import io
    import zipfile

    def run(batches):
        for batch in batches:
            for archive, name in zip(batch.column("archive").to_pylist(), batch.column("name").to_pylist(), strict=True):
                system, at = opened(archive)
                with system.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(name) as raw:
                    held, size, start = [], 0, 1
                    out = lambda held, start: pa.record_batch([pa.repeat(archive, len(held)), pa.repeat(name, len(held)), pa.array(range(start, start + len(held)), pa.int64()), pa.array(held, pa.string())], names=["archive", "name", "line", "value"])  # noqa: B023, E731
                    for text in io.TextIOWrapper(raw, "utf-8", errors="replace", newline=None):
                        held.append(text.removesuffix("\n"))
                        size += len(text)
                        if first_only and held[-1].strip():
                            held, start = held[-1:], start + len(held) - 1
                            break
                        if size >= batch_bytes:
                            yield out(held, start)
                            held, size, start = [], 0, start + len(held)
                    if held:
                        yield out(held, start)

    dealt = members.repartition(F.col("archive"), F.col("name")).select("archive", "name")
    return dealt.mapInArrow(run, "archive string, name string, line long, value string")


def read_zipped_towers(spark: SparkSession, path: str, resolutions: Sequence[str] | None = None, pattern: str = "*.csv") -> DataFrame:
    """The records of all tower files in zip archives, as ``read_tower_csv`` has them, with
    ``file`` (archive and member) and ``resolution``; not sorted.

    ``resolutions`` chooses members by name before any is inflated.
    """
    members = zip_members(spark, path, pattern).withColumn("resolution", resolution(F.col("name")))
    if resolutions is not None:
        members = members.filter(F.col("resolution").isin(list(resolutions)))
    file = F.concat("archive", F.lit("!"), "name").alias("file")
    lines = zip_lines(members).filter(F.trim("value") != "").select(file, "value")
    times = ("TIMESTAMP", "TIMESTAMP_START", "TIMESTAMP_END")
    df = _by_header(spark, lines, zip_lines(members, first_only=True).select(file, F.col("value").alias("header")), times)
    return df.withColumns({c: digits_to_time(F.col(c)) for c in times if c in df.columns}).withColumn("resolution", resolution(F.col("file")))


def unzipped(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(archive, name, content) of the members of zip files that match ``pattern``, whole;
    ``zip_lines`` has members of any size."""
    import fnmatch
    import io
    import zipfile

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if fnmatch.fnmatch(name, pattern):
                            yield pd.DataFrame({"archive": [archive], "name": [name], "content": [z.read(name)]})

    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return zips.mapInPandas(run, "archive string, name string, content binary")


def read_station_archive(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """Observations from ``<network>/<station>/<sensor>_<depth from>_<depth to>….stm`` files.

    Data lines are ``yyyy/MM/dd HH:mm value flag``; header and other lines are left out.
    The depth to which a sensor reaches is the second number of its file name.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parts, fields = F.split("file", "/"), F.split(F.trim("value"), separator)
    name = F.element_at(parts, -1)
    rows = lines.filter(F.col("value").rlike(r"^\s*\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}\s"))
    return rows.select(
        F.element_at(parts, -3).alias("network"), F.element_at(parts, -2).alias("station"), F.regexp_replace(name, r"\.[^.]*$", "").alias("sensor"),
        F.nullif(F.regexp_extract(name, r"_(-?\d+\.\d+)_(-?\d+\.\d+)", 2), F.lit("")).try_cast("double").alias("depth_to"),
        F.try_to_timestamp(F.concat_ws(" ", fields[0], fields[1]), F.lit("yyyy/MM/dd HH:mm")).cast("timestamp_ntz").alias("ts"),
        fields[2].try_cast("double").alias("value"), F.try_element_at(fields, F.lit(4)).alias("flag"),
    ).select(*OBSERVATIONS.fieldNames())
