"""Joins on intervals: points in intervals and overlapping intervals, by buckets of a whole-number axis.

A condition such as ``first <= at AND at <= last`` has no equality to hash on, so Spark would hold
every row against every interval. Here the axis (days, months, any whole numbers) is cut into
buckets of equal width; an interval is put into each bucket it touches, a point into its own, and the
bucket is joined by equality. The exact condition then decides inside the bucket, so the width
changes the cost only: narrow buckets copy long intervals often, wide ones compare more pairs.

A bucket that holds more than 1/256 of the points is split: its points are dealt over several parts
by a hash of ``spread`` and its intervals are copied to each part, so one busy day does not become
one task. Intervals that end before they start hold nothing, and NULL on any side never joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 256


def month_number(day: str | Column) -> Column:
    """Months as whole numbers, one apart for neighbours."""
    return F.year(day) * 12 + F.month(day)


def _bucket(value: Column, width: int) -> Column:
    return F.floor(value.cast("long") / F.lit(width)).cast("long")


def _touched(first: Column, last: Column, width: int) -> Column:
    """The buckets of an interval; none for one without content."""
    some = (first <= last) & first.isNotNull() & last.isNotNull()
    return F.when(some, F.sequence(_bucket(first, width), _bucket(last, width)))


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, at: str, first: str, last: str, width: int, spread: list[str],
) -> DataFrame:
    """Inner join of ``points`` to the intervals with ``first <= at <= last``, columns of both.

    ``at``, ``first`` and ``last`` are whole numbers; ``spread`` names columns of the points (a key)
    by which a busy bucket is dealt out. Column names of the two sides must differ.
    """
    points = points.filter(F.col(at).isNotNull()).withColumn("_bucket", _bucket(F.col(at), width))
    counts = points.groupBy("_bucket").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    # At most HEAVY_SHARE buckets can be busy, so this is small whatever the data.
    busy = F.broadcast(
        counts.filter(F.col("_n") * HEAVY_SHARE > total)
        .select("_bucket", F.ceil(F.col("_n") * HEAVY_SHARE / total).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = points.join(busy, "_bucket", "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int"))
    copied = (
        intervals.withColumn("_bucket", F.explode(_touched(F.col(first), F.col(last), width)))
        .join(busy, "_bucket", "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    )
    met = dealt.drop("_parts").join(copied.drop("_parts"), ["_bucket", "_part"])
    return met.filter(F.col(at).between(F.col(first), F.col(last))).drop("_bucket", "_part")


def overlapping(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int,
) -> DataFrame:
    """Inner join of intervals that share at least one point, columns of both.

    Two intervals can meet in several buckets; the pair counts in the first bucket that both touch,
    so nothing has to be made distinct. Column names of the two sides must differ.
    """
    (a, b), (c, d) = left_span, right_span
    mine = left.withColumn("_bucket", F.explode(_touched(F.col(a), F.col(b), width)))
    other = right.withColumn("_bucket", F.explode(_touched(F.col(c), F.col(d), width)))
    start = _bucket(F.greatest(a, c), width)
    return (
        mine.join(other, "_bucket")
        .filter((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_bucket") == start))
        .drop("_bucket")
    )
