"""Queries on weights: ceilings, histograms, global lowest n, prefixes of bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import CEILINGS, QUANT_BYTES, WEIGHTS, ceilings, quant_bytes, weights
from ..functions.bits import ceiling_q8, log_bucket
from ..operators import ranking as R
from ..registry import query

_MAXIMA = f"with {CEILINGS}, maxima as (select slot, weight // 256 as bucket, greatest(max(ceiling), 0.0) as max_ceiling from ceilings group by all)"


@query("agg1_ceiling_bucket_max", f"{_MAXIMA} select * from maxima")
def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bucket_maxima(ceilings(spark, sf_dir))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ceilings(spark, sf_dir).select("slot", F.col("weight").alias("start"), (F.col("weight") % 700 + 1).alias("length"))


@query(
    "jn7_bucket_range_max",
    f"""{_MAXIMA}, ranges as (select slot, weight as start, weight % 700 + 1 as length from weights)
    select r.slot, r.start, r.length, coalesce(max(m.max_ceiling), 0.0) as max_ceiling
    from ranges r left join maxima m on m.slot = r.slot and m.bucket between r.start // 256 and (r.start + r.length - 1) // 256 group by all""",
)
def jn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.range_maxima(_ranges(spark, sf_dir), R.bucket_maxima(ceilings(spark, sf_dir)))


_BUCKET = "case when value = 0 then 0 else least(greatest(floor((log2(abs(value)))::float) + 128, 1), 256) end::int"


@query("agg2_magnitude_histogram", f"with {WEIGHTS} select {_BUCKET} as bucket, count(*) as n from weights group by 1")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.magnitude_histogram(weights(spark, sf_dir))


@query(
    "win4_histogram_cutoff",
    f"""with {WEIGHTS}, h as (select {_BUCKET} as bucket, count(*) as n from weights group by 1),
    u as (select bucket, sum(n) over (order by bucket) as up from h) select min(bucket) as cutoff from u where up >= 1000""",
)
def win4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram_cutoff(R.magnitude_histogram(weights(spark, sf_dir)), 1000)


@query("top1_lowest_magnitude", f"with {WEIGHTS} select slot, weight, abs(value) as magnitude from weights order by abs(value), slot, weight limit 1000")
def top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lowest(weights(spark, sf_dir), F.abs("value"), 1000).select("slot", "weight", F.col("key").alias("magnitude"))


@query(
    "top2_lowest_magnitude_for_bits",
    f"""with {WEIGHTS}, low as (select slot, weight, abs(value) as key, (weight % 3 + 1) * 2 as bits from weights order by key, slot, weight limit 900),
    u as (select *, sum(bits) over (order by key, slot, weight) as up from low)
    select slot, weight, bits, up::bigint as up from u where up - bits < 900""",
)
def top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = R.lowest(weights(spark, sf_dir), F.abs("value"), 900).withColumn("bits", (F.col("weight") % 3 + 1) * 2)
    return R.prefix_for_bits(low, 900).select("slot", "weight", "bits", "up")


_ANCHOR = f"""with {CEILINGS}, low as (select slot, weight, ceiling as key, 8 as bits from ceilings order by ceiling, slot, weight limit 512),
u as (select *, sum(bits) over (order by key, slot, weight) as up from low),
chosen as (select * from u where up - bits < 512)"""


@query(
    "top3_anchor_placement",
    f"""{_ANCHOR} select (row_number() over (order by slot, weight, bit) - 1)::bigint as ordinal, slot, weight, bit
    from chosen, (select unnest(range(0, 8))::int as bit)""",
)
def top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.anchor_placement(ceilings(spark, sf_dir))


@query(
    "top4_metadata_placement",
    f"""with {WEIGHTS}, low as (select slot, weight, abs(value) as key, 8 as bits from weights order by key, slot, weight limit 300),
    u as (select *, sum(bits) over (order by key, slot, weight) as up from low),
    p as (select (row_number() over (order by slot, weight, bit) - 1)::bigint as ordinal, slot, weight, bit
          from u, (select unnest(range(0, 8))::int as bit) where up - bits < 300)
    select * from p where ordinal < 300""",
)
def top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = R.lowest(weights(spark, sf_dir), F.abs("value"), 300).withColumn("bits", F.lit(8))
    return R.bit_positions(R.prefix_for_bits(low, 300)).where("ordinal < 300")


@query("win3_accumulate_until", f"{_ANCHOR} select slot, weight, up::bigint as up from chosen")
def win3(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = R.lowest(ceilings(spark, sf_dir), F.col("ceiling"), 512).withColumn("bits", F.lit(8))
    return R.prefix_for_bits(low, 512).select("slot", "weight", "up")


@query("win5_ordinal_bits", f"{_ANCHOR} select slot, count(*) as n_bits, min(bit) as first_bit, max(bit) as last_bit from chosen, (select unnest(range(0, 8))::int as bit) group by slot")
def win5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.anchor_placement(ceilings(spark, sf_dir)).groupBy("slot").agg(F.count(F.lit(1)).alias("n_bits"), F.min("bit").alias("first_bit"), F.max("bit").alias("last_bit"))


@query("agg13_distinct_weights", f"{_ANCHOR} select slot, weight, min(bit) as first_bit from chosen, (select unnest(range(0, 8))::int as bit) group by slot, weight")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.anchor_placement(ceilings(spark, sf_dir)).groupBy("slot", "weight").agg(F.min("bit").alias("first_bit"))


@query("fn9_ceiling_f32", f"with {CEILINGS} select slot, count(*) as n, sum(ceiling) as ceilings, max(ceiling) as top from ceilings group by slot".replace("sum(ceiling)", "round(sum(ceiling), 6)"))
def fn9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ceilings(spark, sf_dir).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ceiling"), 6).alias("ceilings"), F.max("ceiling").alias("top"))


@query(
    "fn3_q8_values_and_ceilings",
    f"""with {QUANT_BYTES} select slot, count(*) as n, round(sum(scale * q), 4) as total,
    round(sum(greatest(abs(floor(q / 16.0) * 16), abs(floor(q / 16.0) * 16 + 15)) * abs(scale)), 4) as ceilings from quant_bytes group by slot""",
)
def fn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quant_bytes(spark, sf_dir)
    return x.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("scale") * F.col("q")), 4).alias("total"), F.round(F.sum(ceiling_q8(F.col("q"), F.col("scale"))), 4).alias("ceilings"))


@query("fn10_log_bucket_bounds", f"with {WEIGHTS} select {_BUCKET} as bucket, min(abs(value)) as low, max(abs(value)) as high from weights group by 1")
def fn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).groupBy(log_bucket(F.col("value")).alias("bucket")).agg(F.min(F.abs("value")).alias("low"), F.max(F.abs("value")).alias("high"))


@query(
    "win10_top_k_per_column",
    """with e as (select label, pos, vec_id, abs(embedding[pos + 1]::double) as a from embeddings, (select unnest(range(0, 64)) as pos)),
    r as (select *, row_number() over (partition by label, pos order by a desc, vec_id) as place from e)
    select label, pos::int as pos, vec_id, a, place::int as place from r where place <= 3""",
)
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", F.posexplode("embedding").alias("pos", "v"))
    place = F.row_number().over(W.partitionBy("label", "pos").orderBy(F.desc("a"), "vec_id"))
    return e.withColumn("a", F.abs(F.col("v").cast("double"))).withColumn("place", place).where("place <= 3").select("label", "pos", "vec_id", "a", "place")


@query(
    "agg18_site_order_stats",
    """with n as (select vec_id, label, list_aggregate(list_transform(embedding, lambda x: x::double * x::double), 'sum') as energy from embeddings)
    select label, count(*) as n, round(median(energy), 6) as mid, round(min(energy), 6) as low, round(max(energy), 6) as high from n group by label""",
)
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    energy = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    x = e.select("label", energy.alias("energy"))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("energy", F.lit(0.5)), 6).alias("mid"), F.round(F.min("energy"), 6).alias("low"), F.round(F.max("energy"), 6).alias("high"))


@query(
    "agg19_trace_fraction_rank",
    """with c as (select label, pos, sum(embedding[pos + 1]::double * embedding[pos + 1]::double) as v from embeddings, (select unnest(range(0, 64)) as pos) group by all),
    r as (select label, row_number() over (partition by label order by v desc, pos) as k, sum(v) over (partition by label order by v desc, pos) as up, sum(v) over (partition by label) as total from c)
    select label, min(k)::int as rank from r where up >= 0.9 * total group by label""",
)
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("pos", "v"))
    c = e.groupBy("label", "pos").agg(F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("v"))
    w = W.partitionBy("label").orderBy(F.desc("v"), "pos")
    r = c.select("label", F.row_number().over(w).alias("k"), F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("up"), F.sum("v").over(W.partitionBy("label")).alias("total"))
    return r.where("up >= 0.9 * total").groupBy("label").agg(F.min("k").alias("rank"))
