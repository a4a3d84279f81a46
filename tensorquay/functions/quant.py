"""Dequantisation of whole blocks with numpy, for Arrow UDFs; block layouts are fixed values of the format."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import QUANT_TYPES


def _half(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view("<f2").astype(np.float32)


def _q8_0(b: np.ndarray) -> np.ndarray:
    return _half(b[:, :2]) * b[:, 2:].view(np.int8).astype(np.float32)


def _six_bit_pairs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scales and minima of eight sub-blocks out of twelve bytes: six bits each, the upper four of
    the last eight values keep their two high bits in the first eight bytes."""
    a, m, both = s[:, 0:4], s[:, 4:8], s[:, 8:12]
    scale = np.concatenate([a & 63, (both & 15) | (a >> 6 << 4)], axis=1)
    least = np.concatenate([m & 63, (both >> 4) | (m >> 6 << 4)], axis=1)
    return scale.astype(np.float32), least.astype(np.float32)


def _nibbles(qs: np.ndarray) -> np.ndarray:
    """128 bytes as eight rows of 32: each run of 32 bytes gives its low, then its high halves."""
    runs = qs.reshape(len(qs), 4, 32)
    return np.stack([runs & 15, runs >> 4], axis=2).reshape(len(qs), 8, 32)


def _q4_k(b: np.ndarray) -> np.ndarray:
    d, low = _half(b[:, 0:2]), _half(b[:, 2:4])
    scale, least = _six_bit_pairs(b[:, 4:16])
    q = _nibbles(b[:, 16:144]).astype(np.float32)
    return ((d * scale)[:, :, None] * q - (low * least)[:, :, None]).reshape(len(b), 256)


def _q5_k(b: np.ndarray) -> np.ndarray:
    d, low = _half(b[:, 0:2]), _half(b[:, 2:4])
    scale, least = _six_bit_pairs(b[:, 4:16])
    high = (b[:, None, 16:48] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1
    q = (_nibbles(b[:, 48:176]) | (high << 4)).astype(np.float32)
    return ((d * scale)[:, :, None] * q - (low * least)[:, :, None]).reshape(len(b), 256)


def _q3_k(b: np.ndarray) -> np.ndarray:
    mask, qs, s, d = b[:, 0:32], b[:, 32:96], b[:, 96:108], _half(b[:, 108:110])
    # sixteen 6-bit scales: four bits from the first eight bytes, two from the last four
    low = np.concatenate([s[:, :8] & 15, s[:, :8] >> 4], axis=1)
    high = np.concatenate([(s[:, 8:12] >> k) & 3 for k in (0, 2, 4, 6)], axis=1)
    scale = (low | (high << 4)).astype(np.float32) - 32
    two = (qs.reshape(-1, 2, 1, 32) >> np.array([0, 2, 4, 6], np.uint8)[None, None, :, None]) & 3
    bit = (mask[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1
    q = two.reshape(-1, 8, 32).astype(np.float32) - 4 * (1 - bit.astype(np.float32))
    return (d[:, :, None] * scale.reshape(-1, 16, 1) * q.reshape(-1, 16, 16)).reshape(len(b), 256)


def _q6_k(b: np.ndarray) -> np.ndarray:
    ql, qh, scale, d = b[:, 0:128], b[:, 128:192], b[:, 192:208].view(np.int8).astype(np.float32), _half(b[:, 208:210])
    lows = ql.reshape(-1, 2, 2, 32)
    four = np.concatenate([lows & 15, lows >> 4], axis=2)
    two = (qh.reshape(-1, 2, 1, 32) >> np.array([0, 2, 4, 6], np.uint8)[None, None, :, None]) & 3
    q = (four | (two << 4)).astype(np.float32) - 32
    return (d[:, :, None] * scale.reshape(-1, 16, 1) * q.reshape(-1, 16, 16)).reshape(len(b), 256)


DECODERS = {
    "F32": lambda b: np.ascontiguousarray(b).view("<f4"),
    "F16": _half,
    "Q8_0": _q8_0,
    "Q3_K": _q3_k,
    "Q4_K": _q4_k,
    "Q5_K": _q5_k,
    "Q6_K": _q6_k,
}
BLOCK_BYTES = {name: size for name, size, _, _ in QUANT_TYPES.values()}


def dequantized(kind: str, raw: bytes) -> np.ndarray:
    """All weights of a run of whole blocks."""
    size = BLOCK_BYTES[kind]
    if len(raw) % size:
        raise ValueError(f"{kind}: {len(raw)} bytes are no whole blocks of {size}")
    blocks = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return DECODERS[kind](blocks).reshape(-1)


def dequantize(kind: str | Column, raw: str | Column) -> Column:
    """Weights (array of float) of a column of blocks; an Arrow UDF, null for types without a decoder."""

    @F.pandas_udf("array<float>")
    def run(kinds: pd.Series, raws: pd.Series) -> pd.Series:
        return pd.Series([dequantized(k, r) if k in DECODERS and r is not None else None for k, r in zip(kinds, raws)])

    return run(kind, raw)


#: First byte and bit of the rewritable bits of weight w in a block: where the lowest bits of each
#: weight's own byte lie (fixed values of the format).
def bit_site(kind: str, w: int, bit: int) -> tuple[int, int]:
    """(byte, bit in the byte) of a weight's rewritable bit within its block."""
    if kind == "F32":
        return w * 4, bit
    if kind == "F16":
        return w * 2, bit
    if kind == "Q8_0":
        return 2 + w, bit
    half, place = divmod(w, 128)
    if kind == "Q3_K":
        return 32 + half * 32 + place % 32, place // 32 * 2
    if kind in ("Q4_K", "Q5_K"):
        run, place = divmod(w, 64)
        return (16 if kind == "Q4_K" else 48) + run * 32 + place % 32, place // 32 * 4
    if kind == "Q6_K":
        quarter, l = divmod(place, 32)
        return half * 64 + l + quarter % 2 * 32, quarter // 2 * 4 + bit
    raise ValueError(f"{kind} has no rewritable bits")


def read_bits(kind: str, block: bytes, weights: range, per_weight: int) -> bytes:
    """The payload in the rewritable bits of some weights, least significant bit first."""
    bits = []
    for w in weights:
        for k in range(per_weight):
            byte, at = bit_site(kind, w, k)
            bits.append(block[byte] >> at & 1)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def write_bits(kind: str, block: bytes, weights: range, per_weight: int, payload: bytes) -> bytes:
    """``block`` with the payload in the rewritable bits of some weights."""
    out = bytearray(block)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little").tolist()
    places = ((w, k) for w in weights for k in range(per_weight))
    for value, (w, k) in zip(bits, places):
        byte, at = bit_site(kind, w, k)
        out[byte] = out[byte] & ~(1 << at) | value << at
    return bytes(out)
