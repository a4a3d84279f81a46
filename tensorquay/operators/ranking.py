"""Ranking of weights by magnitude or ceiling, prefixes that hold enough bits, and bucket maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import log_bucket

#: Weights of a bucket of the ceiling summary.
BUCKET = 256


def bucket_maxima(ceilings: DataFrame) -> DataFrame:
    """(slot, bucket, max_ceiling): the largest ceiling of every 256 weights; never below zero."""
    b = F.expr(f"weight div {BUCKET}").alias("bucket")
    return ceilings.groupBy("slot", b).agg(F.greatest(F.max("ceiling"), F.lit(0.0)).alias("max_ceiling"))


def range_maxima(ranges: DataFrame, maxima: DataFrame) -> DataFrame:
    """The largest bucket maximum that each range (slot, start, length) touches.

    Ranges become the buckets they touch and join on equality; partial buckets count whole.
    """
    touched = ranges.select("*", F.explode(F.sequence(F.expr(f"start div {BUCKET}"), F.expr(f"(start + length - 1) div {BUCKET}"))).alias("bucket"))
    keys = ranges.columns
    return touched.join(maxima, ["slot", "bucket"], "left").groupBy(*keys).agg(F.coalesce(F.max("max_ceiling"), F.lit(0.0)).alias("max_ceiling"))


def magnitude_histogram(weights: DataFrame) -> DataFrame:
    """(bucket, n): weights by the logarithm of their magnitude."""
    return weights.groupBy(log_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_cutoff(histogram: DataFrame, n: int) -> DataFrame:
    """The first bucket up to which at least ``n`` weights lie; at most 257 rows are ordered."""
    up = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    return histogram.select("bucket", up.alias("up")).where(F.col("up") >= n).agg(F.min("bucket").alias("cutoff"))


def lowest(weights: DataFrame, by: Column, n: int) -> DataFrame:
    """The ``n`` weights least in (by, slot, weight), as a bounded heap in each task."""
    return weights.withColumn("key", by).orderBy("key", "slot", "weight").limit(n)


def prefix_for_bits(ranked: DataFrame, needed: int, bits: str = "bits") -> DataFrame:
    """The shortest prefix of ``ranked`` (already limited) whose bits reach ``needed``."""
    w = W.orderBy("key", "slot", "weight").rowsBetween(W.unboundedPreceding, 0)
    return ranked.select("*", F.sum(bits).over(w).alias("up")).where(F.col("up") - F.col(bits) < needed)


def bit_positions(chosen: DataFrame, bits: str = "bits") -> DataFrame:
    """(ordinal, slot, weight, bit): every writable bit of the chosen weights, in (slot, weight, bit) order."""
    each = chosen.select("slot", "weight", F.explode(F.sequence(F.lit(0), F.col(bits).cast("int") - 1)).alias("bit"))
    return each.select((F.row_number().over(W.orderBy("slot", "weight", "bit")) - 1).cast("long").alias("ordinal"), "slot", "weight", "bit")


def anchor_placement(ceilings: DataFrame, needed_bits: int = 512, bits_per_weight: int = 8, candidates: int = 512) -> DataFrame:
    """Bit positions for the anchor: among the lowest ceilings, enough weights for the bits."""
    low = lowest(ceilings, F.col("ceiling"), candidates).withColumn("bits", F.lit(bits_per_weight))
    return bit_positions(prefix_for_bits(low, needed_bits))
