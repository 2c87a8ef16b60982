"""Evidence fusion: keep-first merge, corroboration across sources, strongest rows per scope.

A signal row has a scope (an episode, a user), a source, a time in milliseconds and a confidence between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: list[str], at: str, gap: int, ties: list[str]) -> DataFrame:
    """The rows that lie more than ``gap`` after the last row kept of their key, beginning with the first.

    The comparison is with the last row *kept*, so neither a lag nor a session window expresses it. Rows are dealt by key,
    sorted, and folded batch by batch; the state is one key and one time, whatever the size of a key. ``ties`` orders rows
    of equal time. Rows without a time are left out.
    """
    ordered = df.where(F.col(at).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, at, *ties)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times = np.asarray(batch.column(batch.schema.get_field_index(at)), dtype=np.int64)
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            codes = [np.asarray(pc.dictionary_encode(c, null_encoding="encode").indices) for c in columns]
            starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))
            kept = []
            for start, stop in zip(starts, [*starts[1:], len(times)], strict=True):
                key, mine = [c[int(start)].as_py() for c in columns], times[start:stop]
                i = int(np.searchsorted(mine, last + gap, side="right")) if key == held else 0
                held = key
                while i < len(mine):
                    kept.append(start + i)
                    last = int(mine[i])
                    i = int(np.searchsorted(mine, last + gap, side="right"))
            yield batch.take(pa.array(kept, pa.int64()))

    return ordered.mapInArrow(fold, df.schema)


def corroborate(df: DataFrame, scope: list[str], source: str, at: str, confidence: str, within: int) -> DataFrame:
    """``df`` with the confidence of each row raised by the rows of other sources at most ``within`` away: 1 - prod(1 - c).

    One window of the scope gathers the neighbours, so there is no self-join. After ``keep_first`` with a gap of at least
    ``within`` a neighbourhood holds at most two rows of a source.
    """
    near = Window.partitionBy(*scope).orderBy(at).rangeBetween(-within, within)
    gathered = df.withColumn("_near", F.collect_list(F.struct(F.col(source).alias("s"), F.col(confidence).alias("c"))).over(near))
    left = F.aggregate(F.filter("_near", lambda x: x["s"] != F.col(source)), 1 - F.col(confidence).cast("double"), lambda a, x: a * (1 - x["c"]))
    return gathered.withColumn(confidence, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - left))).drop("_near")


def strongest(df: DataFrame, scope: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each scope in the given order, with their rank from 1. The limit is the feature."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col(rank) <= limit)


def dominant(df: DataFrame, scope: list[str], value: str, order: list[Column], sample: int) -> DataFrame:
    """The most frequent value among the first ``sample`` rows of each scope; ties go to the value seen first."""
    first = strongest(df, scope, order, sample, "_place")
    counts = first.groupBy(*scope, value).agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_first"))
    return counts.groupBy(*scope).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("_best")).select(*scope, "_best.*")
