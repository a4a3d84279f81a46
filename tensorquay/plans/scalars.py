"""Queries on scalar functions: half floats, addresses, pre-tokens, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import text as T
from ..registry import query, table

_HALF = "case when e = 0 then s * m * pow(2.0::double, -24) else s * (1 + m / 1024.0::double) * pow(2.0::double, e - 15) end"


@query(
    "fn1_half_floats",
    f"""with b as (select unnest(range(0, 65536))::bigint as bits), x as (select bits, case when bits >= 32768 then -1.0 else 1.0 end::double as s, (bits >> 10) & 31 as e, bits & 1023 as m from b)
    select bits, {_HALF} as value from x where e < 31""",
)
def fn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite half floats by their bits."""
    x = spark.range(65_536).select(F.col("id").alias("bits"))
    return x.where(F.shiftright("bits", 10).bitwiseAND(31) < 31).select("bits", B.half_to_double(F.col("bits")).alias("value"))


@query(
    "fn9_ceiling_half",
    f"""with b as (select unnest(range(0, 31744))::bigint | 15 as bits), x as (select bits, 1.0::double as s, (bits >> 10) & 31 as e, bits & 1023 as m from b)
    select bits, count(*) as n, max({_HALF}) as ceiling from x group by bits""",
)
def fn9_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(31_744).select(F.col("id").bitwiseOR(F.lit(15)).alias("bits"))
    return x.groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.max(B.ceiling_half(F.col("bits"))).alias("ceiling"))


@query("fn19_capacities", "select l_orderkey, l_linenumber, ceil(l_quantity / 8)::bigint as bytes, ceil(l_quantity * 100 / 3)::bigint as weights from lineitem")
def fn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.bytes_for_bits(F.col("l_quantity")).alias("bytes"), B.weights_for_bits(F.col("l_quantity") * 100, F.lit(3)).alias("weights"))


@query("fn20_chunk_bit_address", "select l_orderkey, l_linenumber, l_orderkey * 16 + (l_partkey * 3) // 4 as weight, (l_partkey * 3) % 4 as weight_bit from lineitem")
def fn20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey * 16 + (l_partkey * 3) div 4 as weight", "(l_partkey * 3) % 4 as weight_bit")


@query("prj12_byte_range_bounds", "select o_orderkey, o_orderkey % 900 as first, o_custkey % 300 as n, o_orderkey % 900 + o_custkey % 300 <= 1000 as inside from orders")
def prj12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 900 as first", "o_custkey % 300 as n", "o_orderkey % 900 + o_custkey % 300 <= 1000 as inside")


@query("prj10_null_pointers", "select l_suppkey, count(*) filter (where l_discount = 0) as nulls, count(*) as n from lineitem group by l_suppkey")
def prj10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointer = F.when(F.col("l_discount") == 0, None).otherwise(F.struct("l_orderkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(pointer.isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"))


@query(
    "fn15_placement_bytes",
    """with b as (select l_orderkey as chunk, l_linenumber - 1 as ordinal, (l_partkey % 2)::int as bit from lineitem),
    u as (select chunk, ordinal, max(bit) as bit from b group by all) select chunk, ordinal // 8 as byte, sum(bit * (1 << (ordinal % 8)::int))::bigint as value from u group by 1, 2""",
)
def fn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits in order, eight to a byte, least significant first."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), (F.col("l_linenumber") - 1).alias("ordinal"), (F.col("l_partkey") % 2).cast("int").alias("bit"))
    u = b.groupBy("chunk", "ordinal").agg(F.max("bit").alias("bit"))
    return u.groupBy("chunk", F.expr("ordinal div 8").cast("int").alias("byte")).agg(F.sum(F.expr("shiftleft(cast(bit as bigint), ordinal % 8)")).alias("value"))


@query("fn14_read_bits", "select l_orderkey, l_linenumber, ((l_partkey >> 3) & 1)::int as bit3, (l_partkey | 8) as with3, (l_partkey & ~8::bigint) as without3 from lineitem")
def fn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.getbit(k, F.lit(3)).cast("int").alias("bit3"), k.bitwiseOR(F.lit(8)).alias("with3"), k.bitwiseAND(F.bitwise_not(F.lit(8).cast("long"))).alias("without3"))


@query("fn13_bit_sites", "with w as (select unnest(range(0, 256)) as w) select w, 16 + w // 64 * 32 + w % 32 as byte, w % 64 // 32 * 4 as bit from w")
def fn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the low bit of each weight of a four-bit block lies."""
    return spark.range(256).selectExpr("id as w", "16 + id div 64 * 32 + id % 32 as byte", "id % 64 div 32 * 4 as bit")


@query("fn28_pre_tokens")
def fn28(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pre_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", F.size("p").alias("pieces"), F.sha2(F.array_join("p", "\x1f"), 256).alias("digest"))


@query("fn31_byte_pair_encode")
def fn31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of titles (part names and brands) by ranked merges, and whether they decode to the text."""
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    x = p.select("p_partkey", "text", T.encoded(T.pre_tokens(F.col("text")), path).alias("ids"))
    return x.select("p_partkey", "ids", (T.decoded("ids", path) == F.col("text")).alias("round_trip"))


@query("agg7_capacity_flags", "select l_returnflag, bool_and(l_quantity > 0) as all_positive, bool_or(l_discount = 0) as any_zero from lineitem group by l_returnflag")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.bool_or(F.col("l_discount") == 0).alias("any_zero"))
