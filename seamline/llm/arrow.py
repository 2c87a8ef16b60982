"""Arrow plumbing that the operators share: batches cut by bytes, and columns appended to chosen input columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that one kernel call sees at most, unless a single row is longer.
SLICE_BYTES = 4 << 20


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of ``batch`` whose ``column`` holds about ``limit`` bytes; a longer row is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(size, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings; null reads as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def append_columns(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    made: T.StructType,
    make: Callable[[pa.RecordBatch], list],
    limit: int = SLICE_BYTES,
    more: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df`` plus the ``made`` columns, computed slice by slice in Arrow.

    Only ``keep``, ``text_col`` and ``more`` leave the scan. A kept column whose name is among the made ones (in any case) gives
    way to the made one. ``make`` gets a slice with those columns and returns one list or array per made field.
    """
    taken = {f.name.lower() for f in made}
    keep = [k for k in keep if k.lower() not in taken]
    need = list(dict.fromkeys([*keep, text_col, *(more or [])]))
    source = df.select(*[F.col(quoted(n)) for n in need])
    schema = T.StructType([source.schema[n] for n in keep] + list(made))
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col, limit):
                values = [
                    v if isinstance(v, pa.Array) else pa.array(v, type=kind)
                    for v, kind in zip(make(part), kinds, strict=True)
                ]
                kept = [part.column(part.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, *values], names=schema.names)

    return source.mapInArrow(run, schema)


def offsets_of(lengths) -> np.ndarray:
    """Exclusive prefix sums with the total at the end."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sums(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``rows[offsets[i]:offsets[i + 1]]``; empty segments sum to zero."""
    count = np.diff(offsets)
    out = np.zeros((len(count), *rows.shape[1:]), dtype=rows.dtype)
    full = count > 0
    if full.any():
        out[full] = np.add.reduceat(rows, offsets[:-1][full], axis=0)
    return out


def rewrite_batches(df: DataFrame, text_col: str, change: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with ``change`` applied slice by slice; it returns rows of the same schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col, limit):
                yield change(part)

    return df.mapInArrow(run, df.schema)
