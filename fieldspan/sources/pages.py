"""Catalogues that come in pages: a stream that resumes after the last page it has read.

A page is a JSON file with an array of objects under ``objects``; its name gives its
place, and later pages have greater names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .archive import opened

FORMAT = "object_pages"
#: Pages, and objects of the table, that a partition of a batch is to hold about.
PAGES, HELD = 32, 200_000
OBJECTS = "page string, place long, uri string, station_uri string, time_start string, time_end string"


@dataclass
class Page(InputPartition):
    path: str


class PageReader(DataSourceStreamReader):
    """Offsets are names of pages; a partition is one page."""

    def __init__(self, path: str):
        self.path = path

    def _pages(self) -> list[str]:
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(i.path for i in found if i.is_file and i.base_name.endswith(".json") and not i.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        pages = self._pages()
        return {"page": pages[-1].rsplit("/", 1)[-1] if pages else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        return [Page(p) for p in self._pages() if start["page"] < p.rsplit("/", 1)[-1] <= end["page"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        system, _ = opened(self.path)
        with system.open_input_stream(partition.path) as f:
            objects = json.loads(f.read()).get("objects") or []
        page = partition.path.rsplit("/", 1)[-1]
        for i, o in enumerate(objects):
            yield page, i, o.get("uri"), o.get("station_uri"), o.get("time_start"), o.get("time_end")


class ObjectPages(DataSource):
    """``spark.readStream.format("object_pages").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return OBJECTS

    def streamReader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """The objects of all pages below ``path``, those of new pages as they come.

    A page without objects gives no rows; attributes it leaves out are NULL.
    """
    spark.dataSource.register(ObjectPages)
    return spark.readStream.format(FORMAT).load(path)


def append_new(objects: DataFrame, table: str, checkpoint: str, key: str = "uri", timeout: int | None = None) -> None:
    """Append to the Parquet ``table`` the objects of a stream that it does not have, then end.

    What has been read is kept in ``checkpoint``, so that a further call reads new pages
    only; a batch that is repeated after a failure finds what it wrote and skips it. Of
    several objects of one key the earliest by page and place stays; a NULL key is none.
    Objects and table are dealt by key to more partitions as they grow, so that a task
    sorts no more of a larger batch.
    """
    spark = objects.sparkSession
    shape = objects.schema

    def add(batch: DataFrame, _: int) -> None:
        system, root = opened(table)
        held = None
        if system.get_file_info(root).type == fs.FileType.Directory:
            held = spark.read.schema(shape).parquet(table).select(F.col(key).alias("key_"))
        # a page is a partition, and counting a table reads footers only
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-batch.rdd.getNumPartitions() // PAGES), -(-held.count() // HELD) if held is not None else 0)
        keyed = batch.filter(F.col(key).isNotNull()).withColumn("key_", F.col(key)).repartition(parts, "key_")
        first = F.min_by(F.struct(*batch.columns), F.struct("page", "place"))
        fresh = keyed.groupBy("key_").agg(first.alias("o"))
        if held is not None:
            fresh = fresh.join(held.repartition(parts, "key_"), "key_", "left_anti")
        fresh.select("o.*").write.mode("append").parquet(table)

    query = objects.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    query.stop()
    if query.exception() is not None:
        raise query.exception()
