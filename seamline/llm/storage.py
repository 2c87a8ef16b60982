"""Cutting lineage through tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written, by the application that wrote them, in order; and those that results still read.
_TABLES: dict[str, list[str]] = {}
_READ: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder in local mode, as in tests; on a
    cluster that is an error, as no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="seamline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, read_later: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends here, so a lost executor costs no
    more than a reread. A table that a lazy result reads is marked ``read_later``; others may go before the result is used."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    if read_later:
        _READ.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def remove_written(spark: SparkSession) -> int:
    """Deletes all tables that ``written`` made in this application, once nothing reads them any more; how many they were."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    _READ.difference_update(paths)
    return _remove(spark, paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside the block, when it ends, but for those to be read later."""
    tables = _TABLES.setdefault(spark.sparkContext.applicationId, [])
    before = set(tables)
    try:
        yield
    finally:
        gone = [p for p in tables if p not in before and p not in _READ]
        _remove(spark, gone)
        tables[:] = [p for p in tables if p not in set(gone)]
