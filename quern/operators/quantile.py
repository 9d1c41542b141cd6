"""Exact medians of many or huge groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each doubling of 1 + |value|. A fixed resolution: it decides only how the work is split, never the result.
BUCKETS_PER_OCTAVE = 4096


def _bucket(x: Column) -> Column:
    """An integer that never falls while x rises."""
    return (F.signum(x) * F.floor(F.log2(F.lit(1.0) + F.abs(x)) * BUCKETS_PER_OCTAVE)).cast("bigint")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """The median of ``value`` for each group of ``keys``; the mean of the two middle values if their number is even.

    Null, NaN and infinite values are left out, and a group without any other has no row. Null keys form groups of their own.
    Equal values are counted before the first shuffle. A group is then cut into buckets of near values; only the numbers of rows
    by bucket (at most some ten thousand a group) are ordered within a group, and only the bucket that holds the middle is looked
    at value by value, so that a group with a third of all rows is spread over all tasks. Columns out: keys, ``out`` (double).
    """
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    g = df.where(finite).groupBy(*keys, x.alias("_x")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", _bucket(F.col("_x")))
    by_bucket = g.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    rising = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    t = by_bucket.withColumn("_upto", F.sum("_bn").over(rising)).withColumn("_all", F.sum("_bn").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    before = F.col("_upto") - F.col("_bn")
    holds = lambda rank: (before < rank) & (rank <= F.col("_upto"))
    middle = t.where(holds(low) | holds(high)).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), before.alias("_before"), low.alias("_low"), high.alias("_high")
    )
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    at = g.join(middle, same).withColumn("_to", F.col("_before") + F.sum("_n").over(inside)).withColumn("_from", F.col("_to") - F.col("_n"))
    hit = lambda rank: F.max(F.when((F.col("_from") < F.col(rank)) & (F.col(rank) <= F.col("_to")), F.col("_x")))
    return at.groupBy(*keys).agg(((hit("_low") + hit("_high")) / 2).alias(out))
