"""Column functions for judging a source by its size, rate and address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard bit rates in bits per second.
STANDARD_RATES = (16000, 24000, 32000, 40000, 48000, 56000, 64000, 80000, 96000, 112000, 128000, 160000, 192000, 224000, 256000, 320000)
#: The share of a standard rate that an implied rate may lie below and above it.
RATE_FLOOR, RATE_CEILING = 0.999, 1.015
#: Least and greatest tolerance in bytes, and the part of the declared size between them.
LEAST_TOLERANCE, MOST_TOLERANCE, TOLERANCE_PART = 4096, 100000, 200


def nearest_rate(rate: Column) -> Column:
    """The nearest standard rate, the smaller on ties."""
    options = F.array(*[F.struct(F.abs(F.lit(r) - rate).alias("d"), F.lit(r).alias("r")) for r in STANDARD_RATES])
    return F.array_min(options)["r"]


def implied_rate(size: Column, seconds: Column) -> Column:
    """The standard rate that a size and a duration of a minute or more imply; null where none fits."""
    rate = size * 8.0 / seconds
    near = nearest_rate(rate)
    return F.when((seconds >= 60) & (rate >= near * RATE_FLOOR) & (rate <= near * RATE_CEILING), near)


def size_matches(size: Column, declared: Column, least: int = LEAST_TOLERANCE) -> Column:
    """Whether a size agrees with a positive declared one; null where none is declared."""
    tolerance = F.greatest(F.least(F.floor(declared / TOLERANCE_PART), F.lit(MOST_TOLERANCE)), F.lit(least))
    return F.when(declared > 0, F.abs(size - declared) <= tolerance)


def slots(value: Column) -> Column:
    """The distinct positive whole numbers of a bracketed list, ascending; other entries are passed over."""
    inner = F.regexp_replace(F.regexp_replace(value, r"^\[", ""), r"\]$", "")
    numbers = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0)))


def accepted(size: Column, declared: Column, seconds: Column) -> Column:
    """Null where a source of ``size`` bytes agrees with nothing declared, else a struct of required_rate: null where the
    declared size decides, which is tried first, and the standard rate where the duration does."""
    rate = implied_rate(size, seconds)
    by_size = F.coalesce(size_matches(size, declared), F.lit(False))
    made = lambda r: F.struct(r.cast("int").alias("required_rate"))
    return F.when(by_size, made(F.lit(None))).when(rate.isNotNull(), made(rate))


def first_valid(df: DataFrame, scope: list[str], priority: str, size: str, declared: str, seconds: str) -> DataFrame:
    """For each scope with anything declared the first source, by ``priority``, that is accepted: scope, priority, size, required_rate."""
    asked = df.where((F.coalesce(F.col(declared), F.lit(0)) > 0) | (F.coalesce(F.col(seconds), F.lit(0)) > 0))
    valid = asked.withColumn("_accepted", accepted(F.col(size), F.col(declared), F.col(seconds))).where("_accepted is not null")
    best = F.min_by(F.struct(priority, size, F.col("_accepted.required_rate").alias("required_rate")), F.col(priority))
    return valid.groupBy(*scope).agg(best.alias("_best")).select(*scope, "_best.*")


def url_parameter(url: Column, name: str) -> Column:
    """The decoded value of a query parameter; null without one or where the address is broken."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def final_slots(url: Column) -> Column:
    """The slots that the parameter ``m`` of a final address lists."""
    return F.coalesce(slots(url_parameter(url, "m")), F.array().cast("array<bigint>"))


def fallback_url(url: Column) -> Column:
    """The address that the parameter ``fallback_url`` names, if it is one."""
    found = url_parameter(url, "fallback_url")
    return F.when(found.startswith("http"), found)


def total_of_range(header: Column) -> Column:
    """The whole size that a Content-Range header tells after its last slash; null if it tells none."""
    return F.substring_index(header, "/", -1).try_cast("bigint")
