"""Views of the star-schema tables as the engine's own objects, in Spark and as DuckDB text.

Each view is a plain projection or explosion of one table, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bits import ceiling_f32
from .registry import table

#: Elements of one embedding; a weight's address is vec_id * WIDTH + position.
WIDTH = 64


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, weight, value: every embedding element as one F32 weight; slots are labels."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("label").alias("slot"), "vec_id", F.posexplode("embedding").alias("pos", "value"))
    return x.select("slot", (F.col("vec_id") * WIDTH + F.col("pos")).alias("weight"), F.col("value").cast("double").alias("value"))


WEIGHTS = f"""weights as (
  select label as slot, vec_id * {WIDTH} + pos as weight, embedding[pos + 1]::double as value
  from embeddings, (select unnest(range(0, {WIDTH})) as pos))"""


def ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, weight, ceiling: the largest magnitude each weight can get when its low byte is rewritten."""
    return weights(spark, sf_dir).select("slot", "weight", ceiling_f32(F.col("value")).alias("ceiling"))


_E0 = "floor(log2(case when value = 0 then 1 else abs(value) end))"
CEILINGS = f"""{WEIGHTS},
exponents as (
  select slot, weight, abs(value) as a,
         case when value = 0 then -126 else greatest({_E0} + case when abs(value) >= pow(2.0::double, {_E0} + 1) then 1 else 0 end
           - case when abs(value) < pow(2.0::double, {_E0}) then 1 else 0 end, -126) end as e
  from weights),
ceilings as (
  select slot, weight, (floor(a / pow(2.0::double, e - 23) / 256) * 256 + 255) * pow(2.0::double, e - 23) as ceiling from exponents)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, start, length, ceiling, salience: free runs of weights, disjoint in each slot, from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") % 7).cast("int").alias("slot"),
        (F.col("o_orderkey") * 16).alias("start"),
        (F.col("o_custkey") % 112 + 1).alias("length"),
        F.col("o_totalprice").alias("ceiling"),
        (F.col("o_custkey") % 10 / 10.0).alias("salience"),
    )


RUNS = """runs as (
  select (o_orderkey % 7)::int as slot, o_orderkey * 16 as start, o_custkey % 112 + 1 as length, o_totalprice as ceiling, (o_custkey % 10) / 10.0::double as salience
  from orders)"""


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, dimensions, raw_type, data_offset: tensor descriptors made of parts by arithmetic."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    roles = F.array(*(F.lit(r) for r in ROLES))
    role = F.get(roles, (F.col("k") % len(ROLES)).cast("int"))
    layer = F.expr(f"k div {len(ROLES)}").cast("string")
    name = F.when(role.contains("."), role).otherwise(F.concat(F.lit("blk."), layer, F.lit("."), role, F.lit(".weight")))
    types = F.array(*(F.lit(t) for t in TYPES))
    return p.select(
        F.concat(name, F.when(role.contains("."), F.concat(F.lit("#"), F.col("k").cast("string"))).otherwise(F.lit(""))).alias("name"),
        F.array((F.col("p_size").cast("long") * 32), F.col("k") % 64 + 1).alias("dimensions"),
        F.get(types, F.expr(f"cast(k div 3 % {len(TYPES)} as int)")).alias("raw_type"),
        (F.col("k") * 4096).alias("data_offset"),
    )


ROLES = ("attn_q", "attn_k", "attn_v", "attn_output", "ffn_gate", "ffn_up", "ffn_down", "attn_norm", "ffn_norm", "rope_freqs", "token_embd.weight", "output.weight", "output_norm.weight")
TYPES = (0, 1, 8, 11, 12, 13, 14, 2, 10)
TENSORS = f"""tensors as (
  select case when role like '%.%' then role || '#' || k else 'blk.' || (k // {len(ROLES)}) || '.' || role || '.weight' end as name,
         [p_size::bigint * 32, k % 64 + 1] as dimensions, raw_type, k * 4096 as data_offset
  from (select p_partkey as k, p_size, [{", ".join(f"'{r}'" for r in ROLES)}][p_partkey % {len(ROLES)} + 1] as role,
               {list(TYPES)}[p_partkey // 3 % {len(TYPES)} + 1] as raw_type from part))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: each document as a file under /lang/source."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


FILES = "files as (select doc_id, '/' || lang || '/' || source || '/' || doc_id || '.txt' as path, coalesce(text, '') as content from documents)"


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, layer, token, x: each embedding as the input that one site sees for one token."""
    e = table(spark, sf_dir, "embeddings")
    sites = F.array(*(F.lit(s) for s in SITES))
    return e.select(F.get(sites, F.col("label") % len(SITES)).alias("site"), F.expr(f"label div {len(SITES)}").cast("int").alias("layer"), F.col("vec_id").alias("token"), F.col("embedding").alias("x"))


SITES = ("qkv_input", "attn_output_input", "ffn_gate_up_input", "ffn_down_input")
ACTIVATIONS = f"""activations as (
  select {list(SITES)}[label % {len(SITES)} + 1] as site, (label // {len(SITES)})::int as layer, vec_id as token, embedding as x from embeddings)"""


def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seq, offset, length: buffered writes, in the order of events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 10).cast("long").alias("offset"), (F.col("event_id") % 97 + 1).alias("length"), "event_type")


WRITE_LOG = "write_log as (select user_id as file, event_id as seq, floor(value * 10)::bigint as \"offset\", event_id % 97 + 1 as length, event_type from events)"


def quant_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, weight, q, scale: signed bytes with a scale (Q8_0), from lineitem quantities."""
    x = table(spark, sf_dir, "lineitem")
    q = (F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber") * 31) % 256 - 128
    return x.select((F.col("l_suppkey") % 5).cast("int").alias("slot"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("weight"), q.cast("int").alias("q"), (F.col("l_discount") + 0.01).alias("scale"))


QUANT_BYTES = "quant_bytes as (select (l_suppkey % 5)::int as slot, l_orderkey * 8 + l_linenumber as weight, ((l_quantity::int * 7 + l_linenumber * 31) % 256 - 128)::int as q, l_discount + 0.01 as scale from lineitem)"
