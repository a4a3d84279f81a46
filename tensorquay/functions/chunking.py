"""Content-defined chunking with a gear hash.

The hash takes a byte in and shifts left by one, so its low bits + 1 bits depend on the last bits + 1
bytes only: one convolution over the whole content gives the hash wherever a chunk is that far past its
least size, and just the first positions after each least size are summed anew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64


def _gear() -> np.ndarray:
    """256 outputs of splitmix64 from a fixed seed."""
    state = U(0x123456789ABCDEF0) + U(0x9E3779B97F4A7C15) * np.arange(1, 257, dtype=U)
    z = (state ^ (state >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


GEAR = _gear()


@dataclass(frozen=True)
class Params:
    least: int = 1024
    average: int = 4096
    most: int = 16_384

    def __post_init__(self) -> None:
        if not 0 < self.least < self.average < self.most or self.average & (self.average - 1):
            raise ValueError("sizes must rise, and the average must be a power of two")


def cuts(data: bytes, p: Params = Params()) -> list[int]:
    """The end of each chunk."""
    n, bits = len(data), p.average.bit_length() - 1
    if not n:
        return []
    codes = GEAR[np.frombuffer(data, np.uint8)]
    taps = bits + 1
    rolling = np.zeros(n, U)
    for k in range(min(taps, n)):
        rolling[k:] += codes[: n - k] << U(k)
    strict, loose = U((1 << (bits + 1)) - 1), U((1 << (bits - 1)) - 1)
    strict_at = np.flatnonzero((rolling & strict) == 0)
    loose_at = np.flatnonzero((rolling & loose) == 0)
    out, start = [], 0
    while n - start > p.least:
        first, cap = start + p.least, min(n, start + p.most)
        own = min(first + taps - 1, cap)
        h, end = 0, None
        for i in range(first, own):  # the hash has not yet met all its taps here
            h = ((h << 1) + int(codes[i])) & 0xFFFFFFFFFFFFFFFF
            if not h & int(strict if i < start + p.average else loose):
                end = i
                break
        if end is None:
            middle = min(cap, start + p.average)
            a = np.searchsorted(strict_at, own)
            if a < len(strict_at) and strict_at[a] < middle:
                end = int(strict_at[a])
            else:
                b = np.searchsorted(loose_at, max(own, middle))
                end = int(loose_at[b]) if b < len(loose_at) and loose_at[b] < cap else cap
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_ends(content: str | Column, p: Params = Params()) -> Column:
    """Ends of the chunks of a binary column (array of ints); an Arrow UDF."""

    @F.pandas_udf("array<int>")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else cuts(bytes(c), p) for c in contents])

    return run(content)


class Chunker:
    """The same chunks from bytes that arrive in pieces; holds one chunk at most."""

    def __init__(self, p: Params = Params(), held: bytes = b""):
        self.p, self.held = p, held

    def feed(self, data: bytes) -> list[bytes]:
        """The chunks that are complete now; what may still grow is held."""
        self.held += data
        out = []
        while len(self.held) > self.p.most:
            end = cuts(self.held[: self.p.most + 1], self.p)[0]
            out.append(self.held[:end])
            self.held = self.held[end:]
        return out

    def finish(self) -> list[bytes]:
        out, at = [], 0
        for end in cuts(self.held, self.p):
            out.append(self.held[at:end])
            at = end
        self.held = b""
        return out
