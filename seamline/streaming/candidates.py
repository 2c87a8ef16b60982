"""Streams of signals: keep-first as a stateful operator, counts by event-time window, and a store kept by upserts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seamline.operators.stores import upsert


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="seamline-")


def keep_first_stream(stream: DataFrame, key: str, at: str, gap: int, lateness: int | None = None) -> DataFrame:
    """Key and time (milliseconds) of the rows more than ``gap`` after the last row kept of their key; the state is one time per key.

    Rows are taken in order of time within a micro-batch; a row that comes later with an earlier time is left out. With
    ``lateness`` milliseconds a key's state goes once no row that it would decide about can come in time any more; a row
    that is later than that is kept if its key's state has gone.
    """
    timed = stream.select(key, at)
    if lateness is not None:
        timed = timed.withColumn("_time", F.timestamp_millis(at)).withWatermark("_time", f"{lateness} milliseconds")
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(t for part in parts for t in part[at].dropna().tolist())
        kept = []
        for t in times:
            if last is None or t > last + gap:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
            if lateness is not None:
                state.setTimeoutTimestamp(max(last + gap, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [group[0]] * len(kept), at: kept})

    ends = GroupStateTimeout.NoTimeout if lateness is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} long", "last long", "append", ends)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that its source holds now, as a table under ``folder`` with the query's own checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def windowed_counts(stream: DataFrame, time: str, value: str, width: str, lateness: str) -> DataFrame:
    """Rows by value and event-time window; rows later than the watermark are left out."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    counts = timed.groupBy(F.window("_time", width).alias("w"), value).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), value, "n")


class UpsertSink:
    """A store of one row per key that every micro-batch updates; versions are folders numbered by batch, and the last whole one counts.

    ``batch`` is for ``foreachBatch``. A new sink on the same folder goes on from the last version, so a restarted driver
    loses nothing, and a batch that is replayed changes nothing. The versions before the last two are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, rank: str, arrival: str, schema: str):
        self.spark, self.folder, self.key, self.rank, self.arrival = spark, folder, key, rank, arrival
        self.empty = spark.createDataFrame([], schema)
        self.files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """Numbers of the versions that were written whole, ascending."""
        if not self.files.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self._path(""))]
        return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-") and self.files.exists(self._path(f"{n}/_SUCCESS")))

    @property
    def now(self) -> DataFrame:
        """The store as it stands."""
        numbers = self.versions()
        return self.spark.read.schema(self.empty.schema).parquet(f"{self.folder}/version-{numbers[-1]:012d}") if numbers else self.empty

    def batch(self, rows: DataFrame, number: int) -> None:
        numbers = self.versions()
        if numbers and number <= numbers[-1]:
            return
        found = upsert(self.now, rows.select(*self.empty.columns), self.key, self.rank, self.arrival).drop("changed")
        found.select(*self.empty.columns).write.mode("overwrite").parquet(f"{self.folder}/version-{number:012d}")
        for old in numbers[:-1]:
            self.files.delete(self._path(f"version-{old:012d}"), True)
