"""Intervals and timelines: islands, shifted times, as-of lookups, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _running(scope: list[str], *order: str | Column):
    return Window.partitionBy(*scope).orderBy(*order)


def merge_intervals(df: DataFrame, scope: list[str], start: str, stop: str) -> DataFrame:
    """Touching or overlapping intervals of a scope as one: scope, start, stop and the number of parts."""
    w = _running(scope, start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = df.withColumn("_new", fresh)
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*scope, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("parts")).drop("_island")


def runs(df: DataFrame, scope: list[str], place: str) -> DataFrame:
    """Runs of consecutive places: scope, from_place, to_place (inclusive)."""
    island = F.col(place) - F.row_number().over(_running(scope, place))
    return df.withColumn("_island", island).groupBy(*scope, "_island").agg(F.min(place).alias("from_place"), F.max(place).alias("to_place")).drop("_island")


def shift_times(df: DataFrame, cuts: DataFrame, scope: list[str], at: str, shifted: str = "shifted") -> DataFrame:
    """``df`` with each time less the part of the cuts that lies before it.

    ``cuts`` are disjoint (start, stop) per scope. Times and cuts go through one sorted window together: what is cut
    before a time is the length of the cuts begun so far, less what the last of them still has to run.
    """
    left = df.select(*scope, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"), F.lit(0).cast("long").alias("_length"), F.lit(None).cast("long").alias("_stop"))
    right = cuts.select(*scope, F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), (F.col("stop") - F.col("start")).alias("_length"), F.col("stop").alias("_stop"))
    w = _running(scope, "_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    over = F.greatest(F.lit(0), F.coalesce(F.max("_stop").over(w) - F.col("_t"), F.lit(0)))
    both = left.unionByName(right).withColumn(shifted, F.col("_t") - F.sum("_length").over(w) + over)
    return both.where("_kind = 1").select("_row.*", shifted)


def as_of(df: DataFrame, scope: list[str], at: str, is_anchor: Column, before: str, after: str) -> DataFrame:
    """``df`` with the time of the last anchor at or before, and of the first at or after, each row; null without one."""
    w = _running(scope, at)
    anchor = F.when(is_anchor, F.col(at))
    return df.withColumns({
        before: F.max(anchor).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        after: F.min(anchor).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
    })


def prefix_timeline(df: DataFrame, scope: list[str], at: str, tie: str, amount: Column) -> DataFrame:
    """``df`` with the amount before each row (``before``) and the time to the next row of the scope (``lasts``)."""
    w = _running(scope, at, tie)
    return df.withColumns({
        "before": F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "lasts": F.lead(at).over(w) - F.col(at),
    })


def segments(df: DataFrame, scope: list[str], at: str, tie: str, opens: Column) -> DataFrame:
    """Rows cut into segments wherever ``opens`` holds, except at the first row: segment number, start, stop, rows."""
    w = _running(scope, at, tie)
    numbered = df.withColumn("_open", F.when(opens & (F.row_number().over(w) > 1), 1).otherwise(0))
    numbered = numbered.withColumn("segment", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*scope, "segment").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count(F.lit(1)).alias("n"))


def frame_ranges(frames: DataFrame, requests: DataFrame, scope: list[str]) -> DataFrame:
    """The bytes of whole frames that cover requested times: ``scope``, from_byte, to_byte; null where a request begins past the end.

    ``frames`` have until (the time at which a frame ends), start_byte and end_byte; ``requests`` have since and till, one
    for each scope. The first frame is the first that ends after ``since``, the last the first that ends at ``till`` or
    later, or the last of all.
    """
    both = frames.join(requests.select(*scope, "since", "till"), scope)
    found = both.groupBy(*scope).agg(
        F.min(F.when(F.col("since") < F.col("until"), F.col("start_byte"))).alias("from_byte"),
        F.coalesce(F.min(F.when(F.col("till") <= F.col("until"), F.col("end_byte"))), F.max("end_byte")).alias("_to"),
    )
    return found.select(*scope, "from_byte", F.when(F.col("from_byte").isNotNull(), F.col("_to")).alias("to_byte"))


def merged_tail(segments: DataFrame, scope: list[str], least: float) -> DataFrame:
    """``segments`` with a last one shorter than ``least`` (stop - start) joined to the one before, if there is one."""
    w = Window.partitionBy(*scope)
    last = F.max("segment").over(w)
    short = (last >= 1) & (F.max(F.when(F.col("segment") == last, F.col("stop") - F.col("start"))).over(w) < least)
    kept = segments.withColumns({"_last": last, "_short": short})
    number = F.when(F.col("_short") & (F.col("segment") == F.col("_last")), F.col("segment") - 1).otherwise(F.col("segment"))
    return kept.withColumn("segment", number).groupBy(*scope, "segment").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))
