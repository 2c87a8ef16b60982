"""Keyed stores with ranked provenance: upsert, attribution, prune and revoke, as declarative set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(store: DataFrame, incoming: DataFrame, key: str, rank: str, arrival: str) -> DataFrame:
    """One whole row per key: the strongest rank, the earliest arrival among equals; a stored row gives way only to a
    stronger one. ``changed`` marks the rows that the store did not hold."""
    both = store.withColumn("_new", F.lit(1)).unionByName(incoming.withColumn("_new", F.lit(2)))
    columns = [c for c in store.columns if c != key]
    best = F.min_by(F.struct(*columns, "_new"), F.struct(-F.col(rank), F.col("_new"), F.col(arrival)))
    return both.groupBy(key).agg(best.alias("_best")).select(key, *[f"_best.{c}" for c in columns], (F.col("_best._new") == 2).alias("changed"))


def merge_attribution(attribution: DataFrame, key: str, feed: str, rank: str) -> DataFrame:
    """The strongest rank for each key and feed."""
    return attribution.groupBy(key, feed).agg(F.max(rank).alias(rank))


def prune(store: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """The store without the matched keys."""
    return store.join(matched.select(key).distinct(), key, "left_anti")


def revoke(attribution: DataFrame, matched: DataFrame, key: str, feed: str) -> DataFrame:
    """Attribution without the matched (key, feed) pairs; a key without any feed left is gone with its last row."""
    return attribution.join(matched.select(key, feed).distinct(), [key, feed], "left_anti")


def attributed(matches: DataFrame, attribution: DataFrame, key: str, feed: str) -> DataFrame:
    """Matches with the number of feeds that vouch for their key; none gives 0."""
    counts = attribution.groupBy(key).agg(F.count_distinct(feed).alias("feeds"))
    return matches.join(counts, key, "left").withColumn("feeds", F.coalesce("feeds", F.lit(0)))
