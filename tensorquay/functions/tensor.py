"""Vector functions on array columns, JVM-side, and the dense kernels of a decoder block in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def rmsnorm(x: Column, weight: Column, eps: float = 1e-5) -> Column:
    scale = 1 / F.sqrt(dot(x, x) / F.size(x) + eps)
    return F.zip_with(doubles(x), doubles(weight), lambda v, w: v * scale * w)


def softmax(x: Column) -> Column:
    """Exponentials less the largest, to sum 1; all equal if the largest is not finite."""
    top = F.array_max(doubles(x))
    e = F.transform(doubles(x), lambda v: F.exp(v - top))
    sick = F.isnan(top) | (F.abs(top) == float("inf"))
    return F.when(sick, F.transform(x, lambda v: 1.0 / F.size(x))).otherwise(F.transform(e, lambda v: v / total(e)))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(doubles(gate), doubles(up), lambda g, u: silu(g) * u)


def log_softmax_at(x: Column, target: Column) -> Column:
    top = F.array_max(doubles(x))
    return F.get(doubles(x), target) - (top + F.ln(total(F.transform(doubles(x), lambda v: F.exp(v - top)))))


def rope(x: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotates neighbouring pairs by position * base ** (-2 i / n)."""
    n = F.size(x)
    angle = lambda i: position * F.pow(F.lit(base), -(i - i % 2).cast("double") / n)
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i)
    return F.transform(
        at,
        lambda i: F.when(i % 2 == 0, F.get(x, i).cast("double") * F.cos(angle(i)) - F.get(x, i + 1).cast("double") * F.sin(angle(i))).otherwise(
            F.get(x, i - 1).cast("double") * F.sin(angle(i)) + F.get(x, i).cast("double") * F.cos(angle(i))
        ),
    )


class Decoder:
    """A decoder-only transformer of a few small tensors, for calibration passes; numpy in single precision.

    ``weights`` maps names (token_embd, blk.N.attn_q, ..., output_norm, output) to arrays [out, in].
    ``observe(site, layer, x)`` is called with the input of each group of linear layers.
    """

    def __init__(self, weights: dict[str, np.ndarray], heads: int, kv_heads: int | None = None, base: float = 10_000.0, eps: float = 1e-5, context: int = 2048):
        self.w, self.heads, self.kv_heads, self.base, self.eps, self.context = weights, heads, kv_heads or heads, base, eps, context
        self.layers = 1 + max((int(n.split(".")[1]) for n in weights if n.startswith("blk.")), default=-1)
        self.head = weights.get("output", weights["token_embd"])

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + self.eps) * self.w[name]

    def _rotate(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = x.shape[-1]
        angle = at[:, None] * self.base ** (-np.arange(0, n, 2) / n)
        cos, sin = np.cos(angle)[:, None, :], np.sin(angle)[:, None, :]
        even, odd = x[..., 0::2], x[..., 1::2]
        return np.stack([even * cos - odd * sin, even * sin + odd * cos], axis=-1).reshape(x.shape)

    def run(self, tokens: np.ndarray, cache: list | None = None, observe=None, last_only: bool = False) -> np.ndarray:
        """Logits of each position (or the last); ``cache`` keeps keys and values between calls."""
        past = len(cache[0][0]) if cache else 0
        if past + len(tokens) > self.context:
            raise ValueError("the context is full")
        at = np.arange(past, past + len(tokens))
        x = self.w["token_embd"][tokens].astype(np.float32)
        fresh = []
        for i in range(self.layers):
            w = lambda name: self.w[f"blk.{i}.{name}"]  # noqa: B023, E731
            h = self._norm(x, f"blk.{i}.attn_norm")
            if observe:
                observe("qkv_input", i, h)
            q = self._rotate((h @ w("attn_q").T).reshape(len(x), self.heads, -1), at)
            k = self._rotate((h @ w("attn_k").T).reshape(len(x), self.kv_heads, -1), at)
            v = (h @ w("attn_v").T).reshape(len(x), self.kv_heads, -1)
            if cache:
                k, v = np.concatenate([cache[i][0], k]), np.concatenate([cache[i][1], v])
            fresh.append((k, v))
            share = self.heads // self.kv_heads
            kk, vv = np.repeat(k, share, axis=1), np.repeat(v, share, axis=1)
            score = np.einsum("qhd,khd->hqk", q, kk) / np.sqrt(q.shape[-1])
            score = np.where(np.arange(len(k))[None, None, :] <= at[None, :, None], score, -np.inf)
            p = np.exp(score - score.max(axis=-1, keepdims=True))
            a = np.einsum("hqk,khd->qhd", p / p.sum(axis=-1, keepdims=True), vv).reshape(len(x), -1)
            if observe:
                observe("attn_output_input", i, a)
            x = x + a @ w("attn_output").T
            h = self._norm(x, f"blk.{i}.ffn_norm")
            if observe:
                observe("ffn_gate_up_input", i, h)
            g = h @ w("ffn_gate").T
            u = g / (1 + np.exp(-g)) * (h @ w("ffn_up").T)
            if observe:
                observe("ffn_down_input", i, u)
            x = x + u @ w("ffn_down").T
        if cache is not None:
            cache[:] = fresh
        x = self._norm(x[-1:] if last_only else x, "output_norm")
        return x @ self.head.T

    def read(self, tokens: np.ndarray, step: int = 256, observe=None) -> np.ndarray:
        """Logits after the last of any number of tokens, ``step`` at a time, so that scores stay small."""
        cache: list = []
        for a in range(0, len(tokens), step):
            z = self.run(tokens[a : a + step], cache, observe, last_only=True)
        return z[0]

    def perplexity(self, tokens: np.ndarray, window: int) -> float:
        """exp of the mean negative log-likelihood over windows that do not overlap."""
        if window < 2 or len(tokens) < 2:
            raise ValueError("a window and a text of two tokens are needed")
        losses = []
        for a in range(0, len(tokens), window):
            part = tokens[a : a + window]
            if len(part) < 2:
                break
            z = self.run(part).astype(np.float64)
            top = z.max(axis=1)
            lse = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
            losses.append(lse[:-1] - z[np.arange(len(part) - 1), part[1:]])
        return float(np.exp(np.concatenate(losses).mean()))
