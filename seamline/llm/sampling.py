"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of(id_col: str) -> Column:
    """CRC-32 of the id written in decimal."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


#: UTF-8 bytes of the texts that fitting sees at most.
FIT_BYTES = 64 << 20


def fitting_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int, most_bytes: int = FIT_BYTES) -> list[tuple[int, str, object]]:
    """At most ``limit`` rows ``(id, whole text, label)`` of at most ``most_bytes`` in all, those with the smallest hash of id, in that order.

    The ids are chosen from ids and labels alone, then by the sizes of their texts; only the chosen rows' texts are
    fetched. Rows whose id or label is null are not chosen. An id that is in either table more than once counts once, with
    its smallest label and its shortest text (of equally short ones the first in order); a null text is empty.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), order.alias("at")).orderBy("at", "id", "label").limit(limit).collect()
    found = {}
    for r in chosen:
        found.setdefault(r["id"], r["label"])
    if not found:
        return []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).alias("size"), text.alias("text"))

    def of(ids) -> DataFrame:
        return rows.where(F.col("id").isin([F.lit(i).cast(docs.schema[id_col].dataType) for i in ids]))

    sizes = {r["id"]: r["size"] for r in of(found).groupBy("id").agg(F.min("size").alias("size")).collect()}
    taken, held = [], 0
    for i in found:
        if i in sizes and held + sizes[i] <= most_bytes:
            taken.append(i)
            held += sizes[i]
    if not taken:
        return []
    texts = {r["id"]: r["text"] for r in of(taken).groupBy("id").agg(F.min(F.struct("size", "text"))["text"].alias("text")).collect()}
    return [(i, texts[i], found[i]) for i in taken]
