"""Spectral peaks as a plan over frames that arrive as arrays of values, one row per frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _around(values: Column, i: Column, reach: int) -> Column:
    """The largest value at most ``reach`` bins from bin ``i`` (from 0), that bin included."""
    first = F.greatest(i - reach + 1, F.lit(1))
    return F.array_max(F.slice(values, first, i + reach + 2 - first))


def _beside(values: Column, i: Column, reach: int) -> Column:
    """The largest value at most ``reach`` bins from bin ``i`` (from 0), that bin left out; null if there is none."""
    first = F.greatest(i - reach + 1, F.lit(1))
    return F.array_max(F.concat(F.slice(values, first, i + 1 - first), F.slice(values, i + 2, F.lit(reach))))


def strongest_places(peaks: Column, limit: int) -> Column:
    """Of (strength, bin) structs in order of bin the ``limit`` strongest, taken one after the other into as many places:
    once all are filled, a peak takes the first of the weakest ones' places, and only if it is stronger."""

    def take(held: Column, new: Column) -> Column:
        # No lambda within this one: Spark does not take two plans with such for equal, and would compute both.
        weakest = F.array_min(held["strength"])
        at = F.array_position(held["strength"], weakest).cast("int")
        replaced = F.concat(F.slice(held, F.lit(1), at - 1), F.array(new), F.slice(held, at + 1, F.size(held)))
        return F.when(F.size(held) < limit, F.array_append(held, new)).when(new["strength"] > weakest, replaced).otherwise(held)

    return F.aggregate(F.slice(peaks, limit + 1, F.greatest(F.size(peaks) - limit, F.lit(0))), F.slice(peaks, 1, limit), take)


def spectral_peaks(df: DataFrame, clip: str, frame: str, values: str, least_bin: int, under_max: float, near_frames: int, near_bins: int, limit: int) -> DataFrame:
    """``(clip, frame, bin)`` of strict local maxima at most ``under_max`` under the frame's largest value.

    A peak exceeds every value within ``near_frames`` frames and ``near_bins`` bins; bins below ``least_bin`` are
    neighbours only, and so are the first and last ``near_frames`` frames of a clip. Each frame keeps its ``limit``
    strongest peaks as ``strongest_places`` does. One window per clip brings the neighbouring frames together.
    """
    w = Window.partitionBy(clip).orderBy(frame)
    steps = [k for k in range(-near_frames, near_frames + 1) if k]
    # Each frame's maxima go to its neighbours; they reach beyond its end, as neighbours may be longer.
    bins = F.sequence(F.lit(0), F.size("_v") + F.lit(near_bins - 1))
    maxima = df.select(clip, frame, F.col(values).alias("_v")).withColumn("_m", F.when(F.col("_v").isNotNull(), F.transform(bins, lambda i: _around(F.col("_v"), i, near_bins))))
    near = maxima.select(clip, frame, "_v", *[F.lag("_m", -k).over(w).alias(f"_n{i}") for i, k in enumerate(steps)])
    whole = near.where("_v is not null and " + " and ".join(f"_n{i} is not null" for i in range(len(steps))))
    whole = whole.withColumn("_floor", F.array_max(F.slice("_v", least_bin + 1, F.size("_v"))) - F.lit(under_max))

    def is_peak(v: Column, i: Column) -> Column:
        others = [*[F.get(f"_n{k}", i) for k in range(len(steps))], _beside(F.col("_v"), i, near_bins)]
        above = reduce(Column.__and__, [F.coalesce(v > o, F.lit(True)) for o in others])
        return (i >= least_bin) & (v >= F.col("_floor")) & above & F.coalesce(*others).isNotNull()

    marked = F.array_compact(F.transform("_v", lambda v, i: F.when(is_peak(v, i), F.struct(v.alias("strength"), i.alias("bin")))))
    whole = whole.select(clip, frame, marked.alias("_peaks"))
    whole = whole.select(clip, frame, F.explode(strongest_places(F.col("_peaks"), limit)).alias("_p"))
    return whole.select(clip, frame, F.col("_p.bin").cast("long").alias("bin"))


def landmark_pairs(peaks: DataFrame, clip: str, frame: str, reach: int, fanout: int) -> DataFrame:
    """``(clip, frame, hash)`` of each peak with its next ``fanout`` peaks of later frames at most ``reach`` away.

    The later peaks come from a window over times, not from a self-join; frames hold few peaks, so a neighbourhood does.
    """
    ahead = Window.partitionBy(clip).orderBy(frame).rangeBetween(1, reach)
    later = F.slice(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col("bin").alias("b"))).over(ahead)), 1, fanout)
    pairs = peaks.select(clip, frame, "bin", later.alias("_later")).select(clip, frame, "bin", F.explode("_later").alias("o"))
    packed = F.shiftleft("bin", 15).bitwiseOR(F.shiftleft(F.col("o.b"), 6)).bitwiseOR(F.col("o.f") - F.col(frame))
    return pairs.select(clip, frame, packed.alias("hash"))
