"""Block fingerprints: digests of aligned blocks, content ids, shared blocks, verified runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators.intervals import runs


def whole_blocks(text: Column | str, size: int) -> Column:
    """The consecutive blocks of ``size`` characters of a text, the shorter rest left out, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}"), F.lit(0))


def block_digests(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row for each whole block: id, place and SHA-256."""
    blocks = df.select(id_col, F.posexplode(whole_blocks(text_col, size)).alias("place", "block"))
    return blocks.select(id_col, F.col("place").cast("long").alias("place"), F.sha2("block", 256).alias("digest"))


def content_ids(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row per text: the number of whole blocks, and the SHA-256 of their digests in order."""
    blocks = whole_blocks(F.coalesce(F.col(text_col), F.lit("")), size)
    digests = F.transform(blocks, lambda b: F.sha2(b, 256))
    return df.select(id_col, F.size(blocks).cast("long").alias("blocks"), F.sha2(F.array_join(digests, ""), 256).alias("content_id"))


def shared_blocks(digests: DataFrame, id_col: str) -> DataFrame:
    """Digests that more than one id has: ids, occurrences, smallest id. Groups are counted, not paired."""
    per_id = digests.groupBy("digest", id_col).agg(F.count(F.lit(1)).alias("n"))
    found = per_id.groupBy("digest").agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("occurrences"), F.min(id_col).alias("first_id"))
    return found.where("ids > 1")


def absent_runs(primary: DataFrame, reference: DataFrame, id_col: str) -> DataFrame:
    """Runs of primary blocks that no reference block equals."""
    return runs(primary.join(reference.select("digest").distinct(), "digest", "left_anti"), [id_col], "place")


def longest_verified_run(primary: DataFrame, reference: DataFrame, id_col: str, least: int) -> DataFrame:
    """For each id its longest run of blocks that the reference has, of ``least`` blocks or more; the earliest on ties."""
    known = runs(primary.join(reference.select("digest").distinct(), "digest", "left_semi"), [id_col], "place")
    sized = known.withColumn("blocks", F.col("to_place") - F.col("from_place") + 1).where(F.col("blocks") >= least)
    best = F.max_by(F.struct("from_place", "blocks"), F.struct("blocks", -F.col("from_place")))
    return sized.groupBy(id_col).agg(best.alias("_best")).select(id_col, "_best.*")


def without_cuts(value: Column | str, cuts: Column) -> Column:
    """A text or binary value without its cuts, an array of disjoint ``start`` and ``stop`` (from 0) in order."""
    value = F.col(value) if isinstance(value, str) else value
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["stop"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.lit((1 << 31) - 1)))
    kept = F.zip_with(begins, ends, lambda a, b: F.substring(value, a + 1, b - a))
    return F.aggregate(kept, F.substring(value, 1, 0), lambda all_, part: F.concat(all_, part))
