"""Queries on dirty bitmaps: one bit for each weight, from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bitmaps as B
from ..registry import query, table

SIZE = 2_000_000


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 29 + F.col("l_linenumber")).alias("bit"))


_BITS = f"bits as (select distinct l_orderkey * 29 + l_linenumber as bit from lineitem), inside as (select bit from bits where bit >= 0 and bit < {SIZE})"


@query("agg6_bitmap_pages", f"with {_BITS} select bit // 32768 as page, count(*) as n from inside group by 1")
def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.counted(B.marked(_bits(spark, sf_dir), SIZE))


@query("agg5_bitmap_popcount", f"with {_BITS} select count(*) as dirty, count(distinct bit // 32768) as pages from inside")
def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.counted(B.marked(_bits(spark, sf_dir), SIZE)).agg(F.sum("n").alias("dirty"), F.count(F.lit(1)).alias("pages"))


@query("agg6_bitmap_union", f"with {_BITS}, more as (select o_orderkey * 31 as bit from orders), u as (select bit from inside union select bit from more where bit < {SIZE}) select bit // 32768 as page, count(*) as n from u group by 1")
def agg6_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 31).alias("bit"))
    return B.counted(B.united(B.marked(_bits(spark, sf_dir), SIZE), B.marked(more, SIZE)))


@query("sec2_14_bitmap_probe", f"with {_BITS}, p as (select o_orderkey * 31 as bit from orders) select p.bit, i.bit is not null as is_set from p left join inside i on i.bit = p.bit")
def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.probed(table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 31).alias("bit")), B.marked(_bits(spark, sf_dir), SIZE))


@query(
    "agg7_range_all_dirty",
    f"""with {_BITS}, r as (select p_partkey as id, p_partkey * 29 as start, p_size % 6 as length from part),
    e as (select id, bool_and(i.bit is not null) as all_set from (select id, unnest(range(start, start + length)) as bit from r) x left join inside i on i.bit = x.bit group by id)
    select r.id, r.start, r.length, coalesce(all_set, true) as all_set from r left join e on e.id = r.id""",
)
def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 29).alias("start"), (F.col("p_size") % 6).alias("length"))
    return B.ranges_all_set(r, B.marked(_bits(spark, sf_dir), SIZE)).select("id", "start", "length", "all_set")


@query("snk9_dense_bitmap", f"with {_BITS}, n as (select bit // 32768 as page, count(*) as n from inside group by 1), p as (select unnest(range(0, {-(-SIZE // 32768)})) as page) select p.page, coalesce(n, 0) as n, 4096 as bytes from p left join n on n.page = p.page")
def snk9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.dense(B.marked(_bits(spark, sf_dir), SIZE), -(-SIZE // B.PAGE_BITS))
    return pages.select("page", F.bitmap_count("bits").alias("n"), F.length("bits").alias("bytes"))


@query("dml10_nonzero_pages", f"with {_BITS} select distinct bit // 32768 as page from inside")
def dml10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nonzero(B.dense(B.marked(_bits(spark, sf_dir), SIZE), -(-SIZE // B.PAGE_BITS))).select("page")
