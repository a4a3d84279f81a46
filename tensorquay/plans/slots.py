"""Queries on tensor descriptors: tiers, plans, slots and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import TENSORS, tensors
from ..functions.bits import QUANT_TYPES
from ..operators import slots as S
from ..registry import query

_PER_WEIGHT = "case raw_type " + " ".join(f"when {k} then {v[3]}" for k, v in QUANT_TYPES.items()) + " else 0 end"


def _described(include_all: bool) -> str:
    rest = 3 if include_all else 255
    return f"""{TENSORS}, t1 as (
      select *, case when name like '%attn_q%' or name like '%attn_k%' or name like '%attn_v%' or name like '%attn_output%' then 2
        when name like '%ffn_gate%' or name like '%ffn_up%' or name like '%ffn_down%' then 1
        when contains(name, 'token_embd') or contains(name, 'output.weight') or contains(name, '_norm') then {rest} else 255 end as tier,
        try_cast(regexp_extract(name, '^blk\\.([0-9]+)\\.', 1) as int) as layer,
        list_reduce(dimensions, lambda a, x: a * x)::bigint as weights, {_PER_WEIGHT} as per_weight from tensors),
    described as (
      select *, weights * per_weight as bits, case when per_weight = 0 then 'no_writable_bits'
        when tier = 255 and regexp_matches(name, 'token_embd|output\\.weight|_norm') then 'reserved_tensor' when tier = 255 then 'unknown_role' end as skip_reason
      from t1)"""


_PLAN = f"with {_described(False)}"
_SLOTS = f"""{_PLAN}, slots as (
  select (row_number() over o - 1)::bigint as slot, name, tier, layer, raw_type, weights, per_weight,
         (sum(bits) over (o rows between unbounded preceding and current row) - bits)::bigint as bit_start, (sum(bits) over (o rows between unbounded preceding and current row))::bigint as bit_end
  from described where skip_reason is null window o as (order by tier, layer desc nulls last, name))"""


@query("prj1_tier_classifier", f"with {_described(True)} select name, tier, layer from described")
def prj1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.described(tensors(spark, sf_dir), include_all=True).select("name", "tier", "layer")


@query("prj2_layer_index", f"{_PLAN} select layer, count(*) as n from described group by layer")
def prj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors(spark, sf_dir).groupBy(S.layer(F.col("name")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("prj3_skip_reason", f"{_PLAN} select name, raw_type, skip_reason from described where skip_reason is not null")
def prj3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.skipped(tensors(spark, sf_dir))


@query("prj4_eligibility_split", f"{_PLAN} select coalesce(skip_reason, 'planned') as outcome, count(*) as n, sum(bits)::bigint as bits from described group by 1")
def prj4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.described(tensors(spark, sf_dir))
    return x.groupBy(F.coalesce("skip_reason", F.lit("planned")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("bits").alias("bits"))


@query("prj5_capacity", f"{_PLAN} select name, weights, bits, bits // 8 as bytes from described where skip_reason is null")
def prj5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.planned(tensors(spark, sf_dir)).select("name", "weights", "bits", F.expr("bits div 8").alias("bytes"))


@query("prj6_element_count", f"with {TENSORS} select name, list_reduce(dimensions, lambda a, x: a * x)::bigint as weights from tensors")
def prj6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors(spark, sf_dir).select("name", S.element_count(F.col("dimensions")).alias("weights"))


_SITE = "case regexp_extract(name, '^blk\\.[0-9]+\\.([a-z_]+)\\.weight$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in S.SITE_OF_ROLE.items()) + " end"


@query("prj7_activation_site", f"with {TENSORS} select name, {_SITE} as site from tensors")
def prj7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors(spark, sf_dir).select("name", S.activation_site(F.col("name")).alias("site"))


@query(
    "prj8_compensation_target",
    f"""with {TENSORS}, w as (select name, (data_offset // 64) as weight from tensors)
    select w.name, weight, weight % dimensions[1] as input_channel, weight // dimensions[1] as output_channel from w join tensors t on t.name = w.name""",
)
def prj8(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensors(spark, sf_dir)
    return S.compensation_target(t.select("name", F.expr("data_offset div 64").alias("weight")), t)


@query("top5_plan_order", f"{_SLOTS} select slot, name, tier, layer from slots")
def top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.slot_map(S.planned(tensors(spark, sf_dir))).select(F.col("slot").cast("long").alias("slot"), "name", "tier", "layer")


@query("win1_cumulative_bits", f"{_SLOTS} select slot, name, bit_start, bit_end from slots")
def win1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.slot_map(S.planned(tensors(spark, sf_dir))).select(F.col("slot").cast("long").alias("slot"), "name", "bit_start", "bit_end")


@query("agg3_capacity_totals", f"{_PLAN} select sum(bits)::bigint as bits, (sum(bits) // 8)::bigint as bytes, count(*) as tensors from described where skip_reason is null")
def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.planned(tensors(spark, sf_dir)).agg(F.sum("bits").alias("bits"), F.expr("sum(bits) div 8").alias("bytes"), F.count(F.lit(1)).alias("tensors"))


@query(
    "jn3_bit_to_slot",
    f"""{_SLOTS}, a as (select o_orderkey * 997 as bit from orders)
    select a.bit, s.slot, (a.bit - s.bit_start) // s.per_weight as weight, (a.bit - s.bit_start) % s.per_weight as weight_bit
    from a join slots s on a.bit >= s.bit_start and a.bit < s.bit_end""",
)
def jn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 997).alias("bit"))
    return S.locate(bits, S.slot_map(S.planned(tensors(spark, sf_dir)))).withColumn("slot", F.col("slot").cast("long"))


@query(
    "jn1_salience_join",
    f"""{_SLOTS}, sal as (select name, (data_offset % 1000) / 1000.0::double as salience from tensors where data_offset % 3 = 0)
    select s.slot, s.name, sal.salience, t.dimensions[1] as in_dim from slots s join sal on sal.name = s.name join tensors t on t.name = s.name""",
)
def jn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensors(spark, sf_dir)
    sal = t.where("data_offset % 3 = 0").select("name", (F.col("data_offset") % 1000 / 1000.0).alias("salience"))
    return S.slot_map(S.planned(t)).select(F.col("slot").cast("long").alias("slot"), "name").join(sal, "name").join(t.select("name", F.col("dimensions")[0].alias("in_dim")), "name").select("slot", "name", "salience", "in_dim")


@query(
    "jn2_slot_by_name",
    f"""{_SLOTS}, wanted as (select name, data_offset from tensors) select w.name, s.slot, s.name is not null as found from wanted w left join slots s on s.name = w.name""",
)
def jn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tensors(spark, sf_dir)
    s = S.slot_map(S.planned(t)).select(F.col("slot").cast("long").alias("slot"), F.col("name").alias("s_name"))
    return t.select("name").join(s, F.col("name") == F.col("s_name"), "left").select("name", "slot", F.col("s_name").isNotNull().alias("found"))


@query("fn11_writable_bits", f"with {TENSORS} select raw_type, {_PER_WEIGHT} as per_weight, count(*) as n from tensors group by all")
def fn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.bits import writable_bits

    return tensors(spark, sf_dir).groupBy("raw_type", writable_bits(F.col("raw_type")).alias("per_weight")).agg(F.count(F.lit(1)).alias("n"))


@query("fn12_type_names", f"with {TENSORS} select raw_type, case raw_type {' '.join(f'''when {k} then '{v[0]}' ''' for k, v in QUANT_TYPES.items())} end as type_name, count(*) as n from tensors group by all")
def fn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.bits import type_name

    return tensors(spark, sf_dir).groupBy("raw_type", type_name(F.col("raw_type")).alias("type_name")).agg(F.count(F.lit(1)).alias("n"))




@query("df7_allocator_runs", f"{_SLOTS} select slot, 0::bigint as start, weights as length from slots where weights > 0")
def df7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free run for each slot: the whole of it."""
    return S.slot_map(S.planned(tensors(spark, sf_dir))).where("weights > 0").select(F.col("slot").cast("long").alias("slot"), F.lit(0).cast("long").alias("start"), F.col("weights").alias("length"))


@query(
    "win2_bitmap_offsets",
    f"""{_SLOTS} select slot, (sum(weights) over (order by slot) - weights)::bigint as first_bit, weights from slots""",
)
def win2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    s = S.slot_map(S.planned(tensors(spark, sf_dir)))
    up = F.sum("weights").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    return s.select(F.col("slot").cast("long").alias("slot"), (up - F.col("weights")).alias("first_bit"), "weights")
