"""Session settings that the engine relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Dates are UTC; skewed joins and small partitions are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def setting(spark: SparkSession, name: str, default: str | None = None) -> str:
    """A required setting such as a user id or an email: Spark's own settings come
    first, then the environment. Missing ones fail here, when used, not on import."""
    import os

    value = spark.conf.get(f"spark.fieldspan.{name}", None) or os.environ.get(f"FIELDSPAN_{name.upper()}") or default
    if value is None:
        raise ValueError(f"set spark.fieldspan.{name} or FIELDSPAN_{name.upper()}")
    return value


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Only in local mode, where that setting may be absent, a folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldspan-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables that this process has written to shared folders and not removed, oldest first.
_TABLES: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """The name of a folder beside the written tables, removed as they are."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


def written(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    A later loss of executors re-reads the table in place of recomputing it. ``parts``:
    the files it goes to at most, for tables far smaller than what they come from. The
    table stays until ``kept`` or ``drop_tables`` removes it.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, since: int = 0, last: int | None = None) -> None:
    """Remove the tables ``since`` to ``last`` of those written; plans that read them end."""
    jvm, gone = spark._jvm, _TABLES[since:last]
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        _TABLES.remove(path)


def kept(spark: SparkSession, make) -> DataFrame:
    """The written result of ``make()``, without the tables that were written on the way."""
    since = len(_TABLES)
    out = written(make())
    drop_tables(spark, since, len(_TABLES) - 1)
    return out
