"""Activation statistics by site and layer: mean magnitudes, gram matrices, factors, compensation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from .slots import SITE_OF_ROLE


def channel_salience(activations: DataFrame) -> DataFrame:
    """(site, layer, channel, salience): mean magnitude of every channel, partial sums first."""
    x = activations.select("site", "layer", F.posexplode("x").alias("channel", "v"))
    return x.groupBy("site", "layer", "channel").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("salience"))


def to_tensors(by_site: DataFrame) -> DataFrame:
    """Rows of a site once for each tensor that reads it (column tensor)."""
    roles: dict[str, list[str]] = {}
    for role, site in SITE_OF_ROLE.items():
        roles.setdefault(site, []).append(role)
    table = F.create_map(*(x for site, names in roles.items() for x in (F.lit(site), F.array(*map(F.lit, names)))))
    x = by_site.withColumn("role", F.explode(table[F.col("site")]))
    return x.withColumn("tensor", F.concat(F.lit("blk."), F.col("layer").cast("string"), F.lit("."), "role", F.lit(".weight"))).drop("role")


def gram_pairs(activations: DataFrame) -> DataFrame:
    """(site, layer, i, j, v): mean of x_i * x_j for i <= j, as a table, from arrays of one row each."""
    n = F.size("x")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get(F.col("x"), i).cast("double") * F.get(F.col("x"), j).cast("double")).alias("p")))))
    x = activations.select("site", "layer", F.explode(pairs).alias("e"))
    return x.groupBy("site", "layer", "e.i", "e.j").agg(F.avg("e.p").alias("v"))


def gram(activations: DataFrame) -> DataFrame:
    """(site, layer, n, tokens, tri): packed upper triangles of X'X / tokens.

    Every task sums X'X of its own rows; the sums of one site and layer are then few rows, added up.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(["site", "layer"], dropna=False, sort=False):
                m = np.stack([np.asarray(v, np.float64) for v in part["x"]])
                s = sums.setdefault(key, [np.zeros((m.shape[1], m.shape[1])), 0])
                s[0] += m.T @ m
                s[1] += len(m)
        for (site, layer), (m, tokens) in sums.items():
            yield pd.DataFrame({"site": [site], "layer": [layer], "n": [len(m)], "tokens": [tokens], "tri": [L.packed_upper(m)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = int(pdf["tokens"].sum())
        tri = np.sum(np.stack(list(pdf["tri"])), axis=0) / tokens
        return pdf.head(1).assign(tokens=tokens, tri=[tri])

    schema = "site string, layer int, n int, tokens long, tri array<double>"
    return activations.select("site", "layer", "x").mapInPandas(partial, schema).groupBy("site", "layer").applyInPandas(add, schema)


def factored(grams: DataFrame, damping: float = 0.0) -> DataFrame:
    """(site, layer, n, saliency, factor, error): Cholesky factor and channel saliency of each gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                h = L.unpacked_upper(np.asarray(r.tri), r.n)
                h += np.eye(r.n) * damping * np.trace(h) / r.n
                try:
                    low = L.cholesky(h)
                    out.append((r.site, r.layer, r.n, L.saliency(low), low[np.tril_indices(r.n)], None))
                except ValueError as e:
                    out.append((r.site, r.layer, r.n, None, None, str(e)))
            yield pd.DataFrame(out, columns=["site", "layer", "n", "saliency", "factor", "error"])

    return grams.select("site", "layer", "n", "tri").mapInPandas(run, "site string, layer int, n int, saliency array<double>, factor array<double>, error string")


def reported(grams: DataFrame, rank: int, block: int) -> DataFrame:
    """Errors of low-rank, sparse and block-diagonal forms of each gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"site": r.site, "layer": r.layer, **L.matrix_report(L.unpacked_upper(np.asarray(r.tri), r.n), rank, block)} for r in pdf.itertuples(index=False)])

    return grams.mapInPandas(run, "site string, layer int, low_rank double, sparse double, block double, negative long, asymmetry double")


def regions(deltas: DataFrame) -> DataFrame:
    """(tensor, site, layer, out_channel, channels): deltas summed by channel, zeros dropped, in channel order."""
    key = ["tensor", "site", "layer", "out_channel"]
    each = deltas.where("delta <> 0").groupBy(*key, "channel").agg(F.sum("delta").alias("delta"))
    return each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("channel", "delta"))).alias("channels"))


def compensated(region: DataFrame, grams: DataFrame) -> DataFrame:
    """(tensor, site, layer, out_channel, channel, change): what the free channels must change by.

    A region whose site and layer have no gram is an error before anything is computed.
    """
    missing = region.join(grams, ["site", "layer"], "left_anti").limit(1).count()
    if missing:
        raise ValueError("a region has no gram matrix")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        h = L.unpacked_upper(np.asarray(pdf["tri"].iloc[0]), int(pdf["n"].iloc[0]))
        for r in pdf.itertuples(index=False):
            free, m = L.compensation(h, [c["channel"] for c in r.channels])
            change = m @ np.array([c["delta"] for c in r.channels])
            out += [(r.tensor, r.site, r.layer, r.out_channel, c, d) for c, d in zip(free, change)]
        return pd.DataFrame(out, columns=["tensor", "site", "layer", "out_channel", "channel", "change"])

    # a site's regions are dealt over several tasks; each builds the site's matrix once
    x = region.join(grams.select("site", "layer", "n", "tri"), ["site", "layer"]).withColumn("salt", F.pmod(F.xxhash64("tensor", "out_channel"), F.lit(16)))
    return x.groupBy("site", "layer", "salt").applyInPandas(solve, "tensor string, site string, layer int, out_channel long, channel long, change double")


def nearest_patterns(targets: DataFrame, bits: int = 4) -> DataFrame:
    """For each (id, q, scale, target): the pattern of the low bits of q whose value is nearest; the first wins."""
    c = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))).alias("pattern"))
    value = (F.floor(F.col("q") / (1 << bits)) * (1 << bits) + F.col("pattern")) * F.col("scale")
    best = c.withColumn("error", F.abs(value - F.col("target"))).groupBy("id").agg(F.min(F.struct("error", "pattern")).alias("b"))
    return best.select("id", "b.pattern", "b.error")


def periodic_max(period: str, start: str, length: str):
    """The largest of ``length`` values from ``start`` of a vector that repeats."""
    n = F.size(period)
    twice = F.concat(F.col(period), F.col(period))
    window = F.slice(twice, (F.col(start) % n + 1).cast("int"), F.least(F.col(length), n).cast("int"))
    return F.when(F.col(length) <= 0, F.lit(0.0)).when(F.col(length) >= n, F.array_max(period)).otherwise(F.array_max(window))
