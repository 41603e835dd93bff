"""Joining points with the ranges that cover them, without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a bucket of points, and longest range (in buckets) that is put into each of its buckets.
BUCKET, MOST_BUCKETS = 64, 16


def covering(points: DataFrame, at: str, ranges: DataFrame, first: str, last: str, keys: Sequence[str]) -> DataFrame:
    """Inner join of points and ranges on ``keys`` with ``first <= at <= last``.

    Ranges go to the buckets of points that they touch, so a key with a third of all rows is spread
    over its buckets; the few ranges over many buckets are joined on the keys alone. Every pair comes
    once. Null keys and ends join nothing; reversed ranges are empty. Other columns must not clash.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    wide = bucket(last) - bucket(first) >= MOST_BUCKETS
    usable = ranges.where(F.col(first) <= F.col(last))
    near = usable.where(~wide).withColumn("__bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    hit = F.col(at).between(F.col(first), F.col(last))
    short = points.withColumn("__bucket", bucket(at)).join(near, [*keys, "__bucket"]).where(hit).drop("__bucket")
    return short.unionByName(points.join(usable.where(wide), list(keys)).where(hit))
