"""Ranking, scaling and poles. A row's place among equals is decided by its node id, so every result is the same on every run.

A global rank needs a total order. It is taken in two steps that no single task carries alone: rows are range-partitioned by value, counted per partition, and the
partition's offset is added to the rank within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions


def ordinal(df: DataFrame, value: str, tie: str, by: list[str] | None = None, out: str = "_r", size: str = "_n") -> DataFrame:
    """Adds the 0-based rank of ``value`` (ascending, ties by ``tie``) within the groups ``by``, and the group's size, as ``_r`` and ``_n`` unless named otherwise.

    Rows are bucketed by approximate quantiles of the value, the rank is the bucket's offset plus the place in it: no group is sorted by one
    task, however large. Null values must be filtered out before.
    """
    by = by or []
    width = max(2, 2 * partitions(df.sparkSession))
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / width for i in range(1, width)], 10000).alias("_cuts"))
    joined = df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))  # one row
    bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    placed = joined.withColumn("_bucket", bucket).drop("_cuts")
    sizes = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_count"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    offsets = sizes.withColumn("_before", F.sum("_count").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_count")).withColumn(size, F.sum("_count").over(w)).drop("_count")
    inner = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(value, tie))
    return placed.join(offsets, [*by, "_bucket"]).withColumn(out, (F.col("_before") + inner - 1).cast("long")).drop("_bucket", "_before")


def rank_scores(df: DataFrame, value: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``score``: round(100 r / (n - 1)), r the ordinal rank; 50 for a single row."""
    r = ordinal(df, value, tie, by)
    return r.withColumn("score", F.when(F.col("_n") == 1, 50).otherwise(F.round(100.0 * F.col("_r") / (F.col("_n") - 1)).cast("int"))).drop("_r", "_n")


def rank100(df: DataFrame, value: str, tie: str, invert: bool = False) -> DataFrame:
    """Adds ``score``, unrounded, over the rows that have the value; the others, and an only one, get 50."""
    have = ordinal(df.where(F.col(value).isNotNull()), value, tie).withColumn("score", F.when(F.col("_n") == 1, 50.0).otherwise(100.0 * F.col("_r") / (F.col("_n") - 1))).drop("_r", "_n")
    out = have.unionByName(df.where(F.col(value).isNull()).withColumn("score", F.lit(50.0)))
    return out.withColumn("score", 100.0 - F.col("score")) if invert else out


def min_max100(df: DataFrame, value: str, invert: bool = False) -> DataFrame:
    """Adds ``score``: the value scaled to 0..100 between its extremes; 50 where missing, divisor 1 where all are equal."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1)
    s = F.coalesce((F.col(value) - F.col("_lo")) / span * 100.0, F.lit(50.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("score", 100.0 - s if invert else s).drop("_lo", "_hi")  # one row


def at_rank(df: DataFrame, value: str, place: Column, by: list[str] | None = None, tie: str | None = None, out: str = "v") -> DataFrame:
    """(by, out): the value at the 0-based place ``place``, an expression over ``_n``, of each group's ascending order."""
    r = ordinal(df.where(F.col(value).isNotNull()), value, tie or value, by)
    return r.where(F.col("_r") == place).select(*(by or []), F.col(value).alias(out))


def upper_median(df: DataFrame, value: str, by: list[str] | None = None, out: str = "median") -> DataFrame:
    """The element at n >> 1 of the ascending order: no interpolation, the upper one of an even count."""
    return at_rank(df, value, F.floor(F.col("_n") / 2), by, out=out)


def percentile(df: DataFrame, value: str, p: float, by: list[str] | None = None, out: str = "q") -> DataFrame:
    """The element at floor(p (n - 1)) of the ascending order."""
    return at_rank(df, value, F.floor(F.lit(p) * (F.col("_n") - 1)), by, out=out)


def band(df: DataFrame, value: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Adds ``scaled``: the value mapped so that the band between two percentiles spans -1..1, to 4 decimals; divisor 1 for an empty band."""
    ends = percentile(df, value, lo, out="_a").crossJoin(percentile(df, value, hi, out="_b"))  # one row each
    half = (F.col("_b") - F.col("_a")) / 2
    mid = (F.col("_a") + F.col("_b")) / 2
    return df.crossJoin(F.broadcast(ends)).withColumn("scaled", F.round((F.col(value) - mid) / F.when(half == 0, F.lit(1.0)).otherwise(half), 4)).drop("_a", "_b")


def unit_disc(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds ``dx``, ``dy``: centred on the mean, scaled by the 90th percentile of the radius, clamped to the unit disc, to 4 decimals."""
    mean = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    c = df.crossJoin(F.broadcast(mean)).withColumn("_radius", F.sqrt((F.col(x) - F.col("_mx")) ** 2 + (F.col(y) - F.col("_my")) ** 2))
    r90 = percentile(c, "_radius", 0.9, out="_r90")
    s = c.crossJoin(F.broadcast(r90)).withColumn("_s", F.greatest(F.col("_radius"), F.when(F.col("_r90") == 0, F.lit(1.0)).otherwise(F.col("_r90"))))
    return s.withColumn("dx", F.round((F.col(x) - F.col("_mx")) / F.col("_s"), 4)).withColumn("dy", F.round((F.col(y) - F.col("_my")) / F.col("_s"), 4)).drop("_mx", "_my", "_radius", "_r90", "_s")


def poles(df: DataFrame, by: str, value: str, tie: str, k: int = 14) -> DataFrame:
    """The k lowest and k highest rows of each group, as (…, pole, place)."""
    low = df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(value, tie))).where(F.col("place") <= k).withColumn("pole", F.lit("low"))
    high = df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), F.desc(tie)))).where(F.col("place") <= k).withColumn("pole", F.lit("high"))
    return low.unionByName(high)


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "place") -> DataFrame:
    """The first k rows of each group in the given order; a group is cut down before it is shuffled."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)
