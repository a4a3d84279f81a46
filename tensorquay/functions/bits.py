"""Bit layouts, half floats and ceilings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight types by id: name, bytes of a block, weights of a block, bits of a weight that may be rewritten (fixed values of the container format).
QUANT_TYPES = {
    0: ("F32", 4, 1, 8),
    1: ("F16", 2, 1, 4),
    2: ("Q4_0", 18, 32, 0),
    3: ("Q4_1", 20, 32, 0),
    6: ("Q5_0", 22, 32, 0),
    7: ("Q5_1", 24, 32, 0),
    8: ("Q8_0", 34, 32, 4),
    9: ("Q8_1", 36, 32, 0),
    10: ("Q2_K", 84, 256, 0),
    11: ("Q3_K", 110, 256, 1),
    12: ("Q4_K", 144, 256, 1),
    13: ("Q5_K", 176, 256, 1),
    14: ("Q6_K", 210, 256, 2),
    15: ("Q8_K", 292, 256, 0),
}


def _choose(raw_type: Column, field: int) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in QUANT_TYPES.items() for x in (k, v[field])))
    return table[raw_type]


def type_name(raw_type: Column) -> Column:
    return _choose(raw_type, 0)


def writable_bits(raw_type: Column) -> Column:
    return F.coalesce(_choose(raw_type, 3), F.lit(0))


def half_to_double(bits: Column) -> Column:
    """The value of a half float given as its 16 bits."""
    sign = F.when(F.shiftright(bits, 15).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    e, m = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    special = F.when(m == 0, sign * float("inf")).otherwise(F.lit(float("nan")))
    return F.when(e == 0, sign * m * 2.0**-24).when(e == 31, special).otherwise(sign * (1 + m / 1024.0) * F.pow(F.lit(2.0), e - 15))


def ceiling_f32(x: Column) -> Column:
    """The magnitude of a single float whose low eight bits are all set."""
    a = F.abs(x)
    guess = F.floor(F.log2(F.when(a == 0, 1.0).otherwise(a)))
    exact = guess + F.when(a >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0) - F.when(a < F.pow(F.lit(2.0), guess), 1).otherwise(0)
    e = F.when(a == 0, -126).otherwise(F.greatest(exact, F.lit(-126)))
    unit = F.pow(F.lit(2.0), e - 23)
    return (F.floor(a / unit / 256) * 256 + 255) * unit


def ceiling_half(bits: Column) -> Column:
    """The magnitude of a half float whose low four bits are all set."""
    return F.abs(half_to_double(bits.bitwiseOR(15)))


def ceiling_q8(q: Column, scale: Column) -> Column:
    """The largest magnitude of a signed byte whose low four bits vary, times the block's scale."""
    high = F.floor(q / 16) * 16
    return F.greatest(F.abs(high), F.abs(high + 15)) * F.abs(scale)


def log_bucket(x: Column) -> Column:
    """0 for zero; else the single-precision base-2 logarithm's floor, moved to 1..256."""
    a = F.abs(x)
    rounded = F.floor(F.log2(a).cast("float"))
    return F.when(a == 0, 0).when(F.isnan(a) | (a == float("inf")), 256).otherwise(F.least(F.greatest(rounded + 128, F.lit(1)), F.lit(256))).cast("int")


def bytes_for_bits(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("long")


def weights_for_bits(bits: Column, per_weight: Column) -> Column:
    return F.ceil(bits / per_weight).cast("long")


def upper_offset(i: Column, j: Column, n: Column) -> Column:
    """Index of (i, j), i <= j, in a row-major packed upper triangle."""
    return (i * n - (i * (i - 1) / 2).cast("long") + (j - i)).cast("long")


def lower_offset(i: Column, j: Column) -> Column:
    """Index of (i, j), j <= i, in a row-major packed lower triangle."""
    return ((i * (i + 1) / 2).cast("long") + j).cast("long")
