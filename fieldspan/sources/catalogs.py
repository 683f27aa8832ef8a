"""Catalogues: JSON inside pages, station lists, data objects, spreadsheets, PDF text."""

from __future__ import annotations

import itertools
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree as E

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ATTRIBUTES
from .archive import opened
from .files import list_files

#: Fixed value: how a page assigns an array to a constant.
ARRAY_IN_SCRIPT = r"(?s)const\s+{0}\s*=\s*{1}(\[.*?\]){1}"
_NO_DIGITS = str.maketrans("", "", "0123456789")


def script_json(html: Column, variable: str) -> Column:
    """The JSON array that a page's script assigns to a constant; NULL for none.

    Single quotes around it are tried first, then double quotes; quotes that the script
    escapes once become plain.
    """
    pick = lambda q: F.nullif(F.regexp_extract(html, ARRAY_IN_SCRIPT.format(variable, q), 1), F.lit(""))
    raw = F.coalesce(pick("'"), pick('"'))
    return F.regexp_replace(F.regexp_replace(raw, r'(?<!\\)\\"', '"'), r"(?<!\\)\\'", "'")


def sites_from_page(pages: DataFrame, variable: str, schema: str, html: str = "html") -> DataFrame:
    """Rows of the array of objects in each page; ``schema`` is that of one object.

    A page without the constant fails the query.
    """
    found = script_json(F.col(html), variable)
    checked = F.when(found.isNull(), F.raise_error(F.lit(f"no array {variable} in the page"))).otherwise(found)
    return pages.select(F.from_json(checked, f"array<struct<{schema}>>").alias("sites")).select(F.inline("sites"))


def link_objects(catalogs: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Data objects of several specifications, one after the other, with ``ord``.

    ``limit`` cuts each catalogue, for services that page their answers.
    """
    out = None
    for i, c in enumerate(catalogs):
        c = c if limit is None else c.limit(limit)
        c = c.withColumn("ord", F.struct(F.lit(i).alias("spec"), F.monotonically_increasing_id().alias("row")))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    if out is None:
        raise ValueError("no catalogue")
    return out


def labelling_documents(objects: DataFrame, names: DataFrame, stations: DataFrame, word: str = "labelling") -> DataFrame:
    """(station_id, object, name) of documents whose name has ``word`` in any case.

    ``objects``: object, station; ``names``: object, name; ``stations``: station, station_id.
    """
    hit = names.filter(F.lower("name").contains(word))
    return objects.join(hit, "object").join(stations, "station").select("station_id", "object", "name").orderBy("station_id", "object")


#: Rows of a sheet in a batch.
SHEET_ROWS = 5000


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, member: str, tag: str) -> Iterator[E.Element]:
    """The elements of one name in a member, each dropped once the next is asked for."""
    with book.open(member) as f:
        above: list[E.Element] = []
        inside = 0
        for event, x in E.iterparse(f, ("start", "end")):
            wanted = _plain(x.tag) == tag
            if event == "start":
                above.append(x)
                inside += wanted
                continue
            above.pop()
            inside -= wanted
            if wanted:
                yield x
            # what lies inside an element that is wanted stays until that one has ended
            if above and not inside:
                above[-1].remove(x)


def _sheet(file: BinaryIO, sheet: str) -> Iterator[dict[str, str]]:
    """Rows of a named sheet of the first workbook in a zip file, by its header row.

    The sheet is inflated and parsed as its rows are asked for, so that one row is held,
    beside the workbook's table of shared strings where it has one. The workbook, a zip
    file itself, lies in an unnamed temporary file meanwhile.
    """
    with zipfile.ZipFile(file) as outer:
        books = [n for n in outer.namelist() if n.lower().endswith(".xlsx")]
        if not books:
            return
        with tempfile.TemporaryFile() as held:
            with outer.open(books[0]) as packed:
                shutil.copyfileobj(packed, held, 1 << 20)
            with zipfile.ZipFile(held) as z:
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    shared = ["".join(t.text or "" for t in si.iter() if _plain(t.tag) == "t") for si in _elements(z, "xl/sharedStrings.xml", "si")]
                sheets = [x for x in E.fromstring(z.read("xl/workbook.xml")).iter() if _plain(x.tag) == "sheet"]
                links = {x.get("Id"): x.get("Target") for x in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                rid = next((v for s in sheets if s.get("name") == sheet for k, v in s.attrib.items() if k.endswith("}id")), None)
                if rid is None:
                    return
                target = links[rid].lstrip("/")
                header: dict[str, str] | None = None
                for row in _elements(z, target if target.startswith("xl/") else f"xl/{target}", "row"):
                    cells = {}
                    for c in row:
                        text = "".join(t.text or "" for t in c.iter() if _plain(t.tag) in ("v", "t"))
                        column = c.get("r", "").translate(_NO_DIGITS)
                        cells[column] = shared[int(text)] if c.get("t") == "s" and text else text
                    if header is None:
                        header = cells
                    else:
                        yield {header[k]: v for k, v in cells.items() if k in header and v != ""}


def read_attributes(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """The five attribute columns of ``sheet`` in zipped workbooks, plus ``ord``.

    Archives without a workbook or such a sheet give no rows. SITE_ID, where the sheet
    leaves it out, is what the archive's name has before the first ``_``. A task holds
    SHEET_ROWS rows of one sheet at a time, and no file whole.
    """
    names = ATTRIBUTES.fieldNames()
    kinds = pa.schema([*((n, pa.string()) for n in names), ("ord", pa.int64())])

    def run(batches):
        for batch in batches:
            for p in batch.column("path").to_pylist():
                site = p.rsplit("/", 1)[-1].split("_")[0]
                system, at = opened(p)
                with system.open_input_file(at) as f:
                    rows = ({**r, "SITE_ID": r.get("SITE_ID") or site, "ord": i} for i, r in enumerate(_sheet(f, sheet)))
                    while part := list(itertools.islice(rows, SHEET_ROWS)):
                        yield pa.RecordBatch.from_pylist(part, kinds)

    zips = list_files(spark, path, "*.zip", recursive=False).select("path")
    return zips.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", ord long")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(SITE_ID, file, text) of PDF reports; needs the optional package ``pypdf``.

    SITE_ID is the folder above the one that holds the file. Pages that have text are
    headed ``--- Page n ---`` and joined by a blank line; unreadable files give NULL.
    """

    def run(batches):
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pypdf") from e
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = [(i + 1, page.extract_text() or "") for i, page in enumerate(PdfReader(io.BytesIO(content)).pages)]
                    text = "\n\n".join(f"--- Page {i} ---\n{t}" for i, t in pages if t.strip())
                except Exception:
                    text = None
                out.append((p.split("/")[-3], p, text))
            yield pd.DataFrame(out, columns=["SITE_ID", "file", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "SITE_ID string, file string, text string")
