"""Queries on activations: salience, gram matrices, factors, compensation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ACTIVATIONS, activations
from ..operators import calibration as C
from ..registry import query, table

_LONG = f"{ACTIVATIONS}, el as (select site, layer, token, (pos - 1)::int as channel, x[pos]::double as v from activations, (select unnest(range(1, 65)) as pos))"


@query("agg9_channel_salience", f"with {_LONG} select site, layer, channel, round(avg(abs(v)), 8) as salience from el group by all")
def agg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.channel_salience(activations(spark, sf_dir)).withColumn("salience", F.round("salience", 8))


_ROLES = "roles as (select * from (values " + ", ".join(f"('{r}', '{s}')" for r, s in C.SITE_OF_ROLE.items()) + ") t(role, site))"


@query("agg9_salience_by_tensor", f"with {_LONG}, {_ROLES}, s as (select site, layer, channel, avg(abs(v)) as salience from el group by all) select 'blk.' || layer || '.' || role || '.weight' as tensor, count(*) as channels, round(max(salience), 8) as top from s join roles on roles.site = s.site group by 1")
def agg9_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = C.to_tensors(C.channel_salience(activations(spark, sf_dir)))
    return x.groupBy("tensor").agg(F.count(F.lit(1)).alias("channels"), F.round(F.max("salience"), 8).alias("top"))


@query("agg10_gram_matrix", f"with {_LONG} select a.site, a.layer, a.channel as i, b.channel as j, round(avg(a.v * b.v), 8) as v from el a join el b on a.site = b.site and a.layer = b.layer and a.token = b.token and a.channel <= b.channel group by all")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed triangles from per-task sums, as (i, j, v) rows."""
    g = C.gram(activations(spark, sf_dir))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.transform(F.sequence(i, F.col("n") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    x = g.select("site", "layer", F.explode(F.arrays_zip(pairs.alias("at"), "tri")).alias("e"))
    return x.select("site", "layer", "e.at.i", "e.at.j", F.round("e.tri", 8).alias("v"))


@query("agg11_partial_and_final", f"with {ACTIVATIONS} select site, layer, count(*) as tokens, round(sum(list_sum(list_transform(x, lambda v: v::double))), 6) as total from activations group by all")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return activations(spark, sf_dir).groupBy("site", "layer").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum(s), 6).alias("total"))


@query("fn43_cholesky_saliency")
def fn43(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.factored(C.gram(activations(spark, sf_dir)), damping=0.01)
    return f.select("site", "layer", "n", F.size("factor").alias("packed"), F.transform("saliency", lambda v: F.round(v, 6)).alias("saliency"), "error")


@query("agg20_matrix_errors")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.reported(C.gram(activations(spark, sf_dir)), rank=16, block=16)
    return r.select("site", "layer", *(F.round(c, 6).alias(c) for c in ("low_rank", "sparse", "block")), "negative")


_DELTAS = """deltas as (select 'blk.' || (l_suppkey % 2) || '.attn_q.weight' as tensor, 'qkv_input' as site, (l_suppkey % 2)::int as layer, l_partkey % 50 as out_channel, l_orderkey % 64 as channel,
  case when l_linenumber = 1 then 0.0 else l_linenumber * 0.25 - 1 end::double as delta from lineitem)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    layer = (F.col("l_suppkey") % 2).cast("int")
    return x.select(
        F.concat(F.lit("blk."), layer.cast("string"), F.lit(".attn_q.weight")).alias("tensor"),
        F.lit("qkv_input").alias("site"),
        layer.alias("layer"),
        (F.col("l_partkey") % 50).alias("out_channel"),
        (F.col("l_orderkey") % 64).alias("channel"),
        F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_linenumber") * 0.25 - 1).alias("delta"),
    )


@query("agg14_region_sums", f"with {_DELTAS} select tensor, site, layer, out_channel, channel, round(sum(delta), 6) as delta from deltas where delta <> 0 group by all")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.regions(_deltas(spark, sf_dir)).withColumn("c", F.explode("channels"))
    return r.select("tensor", "site", "layer", "out_channel", "c.channel", F.round("c.delta", 6).alias("delta"))


@query("agg15_region_channels", f"with {_DELTAS} select tensor, layer, out_channel, list_sort(list(distinct channel)) as channels from deltas group by all")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).groupBy("tensor", "layer", "out_channel").agg(F.sort_array(F.collect_set("channel")).alias("channels"))


@query("prj9_zero_delta_filter", f"with {_DELTAS} select layer, count(*) as n from deltas where delta <> 0 group by layer")
def prj9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).where("delta <> 0").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("df25_compensated_write")
def df25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a few channels, each answered by the free channels of its site's matrix."""
    a = activations(spark, sf_dir).withColumn("site", F.lit("qkv_input")).withColumn("layer", (F.col("token") % 2).cast("int"))
    few = _deltas(spark, sf_dir).where("channel < 8")  # a region of all channels has no free ones to answer
    out = C.compensated(C.regions(few), C.gram(a))
    return out.select("tensor", "out_channel", "channel", F.round("change", 6).alias("change"))


_NEAREST = "t as (select l_orderkey * 8 + l_linenumber as id, ((l_quantity::int * 7 + l_linenumber * 31) % 256 - 128) as q, l_discount + 0.01 as scale, l_tax * 20 - 0.5 as target from lineitem)"


@query(
    "top9_nearest_pattern",
    f"""with {_NEAREST}, b as (select id, list_min(list_transform(range(0, 16), lambda p: struct_pack(error := abs((floor(q / 16.0) * 16 + p) * scale - target), pattern := p::int))) as b from t)
    select id, b.pattern as pattern, round(b.error, 8) as error from b""",
)
def top9(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    t = x.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        ((F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber") * 31) % 256 - 128).alias("q"),
        (F.col("l_discount") + 0.01).alias("scale"),
        (F.col("l_tax") * 20 - 0.5).alias("target"),
    )
    # a row's patterns need no shuffle: the least of sixteen structs
    candidates = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.struct(F.abs((F.floor(F.col("q") / 16.0) * 16 + p) * F.col("scale") - F.col("target")).alias("error"), p.alias("pattern")))
    return t.select("id", F.array_min(candidates).alias("b")).select("id", "b.pattern", F.round("b.error", 8).alias("error"))


@query(
    "fn50_periodic_max",
    """with e as (select vec_id, list_transform(embedding, lambda x: abs(x::double)) as p, vec_id * 13 as start, vec_id % 80 as len from embeddings)
    select vec_id, round(p[start % 64 + 1], 8) as at_start, round(case when len = 0 then 0 when len >= 64 then list_max(p) else list_max(list_slice(list_concat(p, p), start % 64 + 1, start % 64 + len)) end, 8) as top from e""",
)
def fn50(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("p"), (F.col("vec_id") * 13).alias("start"), (F.col("vec_id") % 80).alias("len"))
    return e.select("vec_id", F.round(F.get("p", (F.col("start") % F.size("p")).cast("int")), 8).alias("at_start"), F.round(C.periodic_max("p", "start", "len"), 8).alias("top"))


@query("agg17_salience_validity", "select label, count(*) as n, count(*) filter (where list_bool_and(list_transform(embedding, lambda x: isfinite(x) and x >= 0))) as valid, round(max(list_max(embedding))::double, 6) as top from embeddings group by label")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= 0))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(fine).alias("valid"), F.round(F.max(F.array_max("embedding")).cast("double"), 6).alias("top"))


@query("agg21_resident_bytes", f"with {ACTIVATIONS} select site, layer, (max(len(x)) * (max(len(x)) + 1) // 2 * 4)::bigint as factor_bytes, sum(len(x) * 4)::bigint as activation_bytes from activations group by all")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.max(F.size("x")).cast("long")
    return activations(spark, sf_dir).groupBy("site", "layer").agg(F.floor(n * (n + 1) / 2 * 4).cast("long").alias("factor_bytes"), F.sum(F.size("x") * 4).alias("activation_bytes"))


@query("fn52_storage_cost", """with n as (select unnest([64, 576, 1536, 4096])::bigint as n) select n, n * (n + 1) // 2 * 4 as full_bytes, n * 64 * 4 as low_rank_bytes, n * 64 * 8 as sparse_bytes, n * 64 * 4 // 2 as block_bytes,
    case when n * 64 * 4 < n * (n + 1) // 2 * 4 then 'low_rank' else 'full' end as cheapest from n""")
def fn52(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.createDataFrame([(64,), (576,), (1536,), (4096,)], "n long")
    return n.selectExpr("n", "n * (n + 1) div 2 * 4 as full_bytes", "n * 64 * 4 as low_rank_bytes", "n * 64 * 8 as sparse_bytes", "n * 64 * 4 div 2 as block_bytes", "case when n * 64 * 4 < n * (n + 1) div 2 * 4 then 'low_rank' else 'full' end as cheapest")


@query("fn21_triangle_offsets", "with p as (select unnest(range(0, 64)) as i), q as (select unnest(range(0, 64)) as j) select i, j, i * 64 - i * (i - 1) // 2 + (j - i) as upper_at, j * (j + 1) // 2 + i as lower_at from p, q where i <= j")
def fn21(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.bits import lower_offset, upper_offset

    i = spark.range(64).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id"), F.lit(63).cast("long"))).alias("j"))
    return i.select("i", "j", upper_offset(F.col("i"), F.col("j"), F.lit(64)).alias("upper_at"), lower_offset(F.col("j"), F.col("i")).alias("lower_at"))
