"""Sparse bitmaps as tables of 4 KB pages, with Spark's bitmap functions.

Spark's pages are numbered from 1 and hold positions 1..32768 of each, so bit + 1 goes in and page - 1
comes out; a page that no bit touches has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 32_768


def marked(bits: DataFrame, size: int | None = None) -> DataFrame:
    """(page, bits): the pages of the set bits (column bit); bits outside 0..size-1 are ignored."""
    x = bits.where("bit >= 0" + (f" and bit < {size}" if size is not None else "")).withColumn("at", F.col("bit") + 1)
    return x.groupBy((F.bitmap_bucket_number("at") - 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at"))).alias("bits"))


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("page").agg(F.bitmap_or_agg(F.col("bits")).alias("bits"))


def counted(pages: DataFrame) -> DataFrame:
    return pages.select("page", F.bitmap_count(F.col("bits")).alias("n"))


def probed(bits: DataFrame, pages: DataFrame) -> DataFrame:
    """Each bit with whether it is set."""
    x = bits.withColumn("page", F.expr(f"bit div {PAGE_BITS}")).withColumn("within", F.col("bit") % PAGE_BITS)
    x = x.join(pages, "page", "left")
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(within div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    is_set = F.get(F.array(*(byte.bitwiseAND(1 << i) != 0 for i in range(8))), (F.col("within") % 8).cast("int"))
    return x.withColumn("is_set", F.coalesce(is_set, F.lit(False))).drop("page", "within", "bits")


def ranges_all_set(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Each range (id, start, length) with whether all its bits are set (true for an empty one)."""
    bits = ranges.where("length > 0").select("id", F.explode(F.expr("sequence(start, start + length - 1)")).alias("bit"))
    full = probed(bits, pages).groupBy("id").agg(F.bool_and("is_set").alias("all_set"))
    return ranges.join(full, "id", "left").withColumn("all_set", F.coalesce("all_set", F.lit(True)))


def dense(pages: DataFrame, count: int) -> DataFrame:
    """All ``count`` pages, with zeros where there is no row."""
    spark = pages.sparkSession
    zero = F.unhex(F.repeat(F.lit("00"), PAGE_BITS // 8))
    return spark.range(count).withColumnRenamed("id", "page").join(pages, "page", "left").select("page", F.coalesce("bits", zero).alias("bits"))


def nonzero(pages: DataFrame) -> DataFrame:
    return pages.where(F.bitmap_count(F.col("bits")) > 0)
