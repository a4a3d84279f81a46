"""Which tensors can hold data, in which order, and where each one's bits begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import writable_bits

TIER_SKIP = 255


def tier(name: Column, include_all: bool = False) -> Column:
    """Attention tensors 2, feed-forward 1, embeddings, head and norms 3 (only with ``include_all``), else skipped."""
    has = lambda *parts: F.exists(F.array(*(name.contains(p) for p in parts)), lambda x: x)
    rest = has("token_embd", "output.weight", "_norm")
    return F.when(has("attn_q", "attn_k", "attn_v", "attn_output"), 2).when(has("ffn_gate", "ffn_up", "ffn_down"), 1).when(rest, 3 if include_all else TIER_SKIP).otherwise(TIER_SKIP)


def layer(name: Column) -> Column:
    """The number after ``blk.``, or null."""
    return F.regexp_extract(name, r"^blk\.([0-9]+)\.", 1).try_cast("int")


def element_count(dimensions: Column) -> Column:
    return F.aggregate(dimensions, F.lit(1).cast("long"), lambda a, x: a * x)


def described(tensors: DataFrame, include_all: bool = False) -> DataFrame:
    """``tensors`` with tier, layer, weights, bits of a weight, bits, and the reason if skipped."""
    x = tensors.withColumn("tier", tier(F.col("name"), include_all)).withColumn("layer", layer(F.col("name"))).withColumn("weights", element_count(F.col("dimensions")))
    x = x.withColumn("per_weight", writable_bits(F.col("raw_type"))).withColumn("bits", F.col("weights") * F.col("per_weight"))
    known = F.col("raw_type").isin(0, 1, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
    reason = F.when(~known, "unsupported_type").when(F.col("per_weight") == 0, "no_writable_bits").when((F.col("tier") == TIER_SKIP) & F.col("name").rlike("token_embd|output\\.weight|_norm"), "reserved_tensor").when(F.col("tier") == TIER_SKIP, "unknown_role")
    return x.withColumn("skip_reason", reason)


def planned(tensors: DataFrame, include_all: bool = False) -> DataFrame:
    return described(tensors, include_all).where("skip_reason is null").drop("skip_reason")


def skipped(tensors: DataFrame, include_all: bool = False) -> DataFrame:
    return described(tensors, include_all).where("skip_reason is not null").select("name", "raw_type", "skip_reason")


def plan_order() -> list[Column]:
    return [F.col("tier").asc(), F.col("layer").desc_nulls_last(), F.col("name").asc()]


def slot_map(plan: DataFrame) -> DataFrame:
    """slot, name, bit_start, bit_end: cumulative bit ranges in plan order (one row for each tensor)."""
    w = W.orderBy(*plan_order())
    up = F.sum("bits").over(w.rowsBetween(W.unboundedPreceding, 0))
    return plan.select((F.row_number().over(w) - 1).alias("slot"), "name", "tier", "layer", "raw_type", "weights", "per_weight", (up - F.col("bits")).alias("bit_start"), up.alias("bit_end"))


def locate(bits: DataFrame, slots: DataFrame) -> DataFrame:
    """The slot, weight and bit of each logical bit address (column bit).

    Addresses join ranges by equality on coarse pages that both sides emit, so no nested loop over
    all pairs is needed; a range stands on each page it touches.
    """
    page = 1 << 20
    wide = slots.where("bit_end > bit_start").select("slot", "per_weight", "bit_start", "bit_end", F.explode(F.sequence(F.expr(f"bit_start div {page}"), F.expr(f"(bit_end - 1) div {page}"))).alias("page"))
    x = bits.withColumn("page", F.expr(f"bit div {page}")).join(wide, "page").where("bit >= bit_start and bit < bit_end")
    off = F.col("bit") - F.col("bit_start")
    return x.select("bit", "slot", F.floor(off / F.col("per_weight")).alias("weight"), (off % F.col("per_weight")).alias("weight_bit"))


def compensation_target(weights: DataFrame, tensors: DataFrame) -> DataFrame:
    """The input and output channel of each weight (name, weight) of a two-dimensional tensor."""
    dims = tensors.where(F.size("dimensions") == 2).select("name", F.col("dimensions")[0].alias("in_dim"))
    x = weights.join(dims, "name", "left")
    return x.withColumn("input_channel", F.col("weight") % F.col("in_dim")).withColumn("output_channel", F.expr("weight div in_dim")).drop("in_dim")


#: Tensor role -> the site whose input it reads (fixed values).
SITE_OF_ROLE = {
    "attn_q": "qkv_input",
    "attn_k": "qkv_input",
    "attn_v": "qkv_input",
    "attn_output": "attn_output_input",
    "ffn_gate": "ffn_gate_up_input",
    "ffn_up": "ffn_gate_up_input",
    "ffn_down": "ffn_down_input",
}


def activation_site(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SITE_OF_ROLE.items() for x in kv))
    return table[F.regexp_extract(name, r"^blk\.[0-9]+\.([a-z_]+)\.weight$", 1)]
