"""Quality classifier by positive-unlabelled learning (operator 6).

A linear model on the text's shape (frequencies of the first and last byte of its words, and shares of
capitals, symbols, repeats and the like) is fitted by minimising the non-negative unbiased risk: the
trusted positives give the positive class's risk, unlabelled documents less the positives' part of them
give the negative class's, and where that estimate turns negative its gradient is reversed.  The class
prior is the share of positives among the audited rows of the training part.

Labels are learned only from rows whose crc32(doc_id) mod 4 is not 2; labels, language, source and
doc_id are never inputs of a score.  The fit uses a bounded sample, chosen by a hash of doc_id:
SAMPLE positives and about SAMPLE unlabelled documents; all documents are scored.

Defined cases: a null or empty text has the features of no words and gets a score; a null doc_id is not
held out; without any positive label the score is the prior; repeated rows get equal scores; texts are
read whole; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import counts
from .text_kernels import Words, buffers, slices, tidy

#: Rows of each kind that the fit sees.
SAMPLE = 8_000
THRESHOLD = 0.7
SHAPES = 12
DIMS = 512 + SHAPES + 1


def features(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of DIMS numbers for each document of a slice."""
    docs = len(offs) - 1
    w = Words(b, offs)
    out = np.zeros((docs, DIMS), np.float32)
    n = np.maximum(w.count, 1).astype(np.float32)
    if len(w.start):
        doc = w.doc
        first = np.bincount(doc * 256 + b[w.start], minlength=docs * 256).reshape(docs, 256)
        last = np.bincount(doc * 256 + b[w.stop - 1], minlength=docs * 256).reshape(docs, 256)
        out[:, :256] = np.sqrt(first / n[:, None])
        out[:, 256:512] = np.sqrt(last / n[:, None])
        h = w.hash
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        of = np.zeros(docs, np.int64)
        # distinct words: a word counts where no equal one of its document stands before it in hash order
        order = np.lexsort((h, doc))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        np.add.at(of, doc[order][fresh], 1)
        s = 512
        out[:, s + 0] = np.bincount(doc[same], minlength=docs) / n
        out[:, s + 1] = of / n
    c = {k: v.astype(np.float32) for k, v in counts(b, offs).items()}
    chars, lines, s = np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1), 512
    out[:, s + 2] = np.minimum(c["n_symbols"] / n, 2)
    out[:, s + 3] = np.minimum(c["n_bangs"] / n, 2)
    out[:, s + 4] = c["n_upper"] / chars
    out[:, s + 5] = c["n_repeat_words"] / n
    out[:, s + 6] = c["n_dup_lines"] / lines
    out[:, s + 7] = np.minimum(chars / n / 10, 3)
    out[:, s + 8] = np.minimum(n / lines / 20, 3)
    out[:, s + 9] = np.log1p(c["n_words"]) / 10
    out[:, s + 10] = np.sqrt(np.minimum(c["n_symbols"] / n, 1))
    out[:, s + 11] = c["n_words"] < 5
    out[:, -1] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Fit:
    weight: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        # each row by itself, so that equal texts have equal scores wherever they stand
        return sigmoid((x.astype(np.float64) * self.weight).sum(axis=1))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 1e-4) -> Fit:
    """Adam on the non-negative risk: prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)])."""
    w = np.zeros(DIMS)
    if not len(positive) or not len(unlabelled):
        w[-1] = np.log(prior / (1 - prior))
        return Fit(w, prior)
    m, v = np.zeros(DIMS), np.zeros(DIMS)
    for t in range(1, steps + 1):
        zp, zu = positive @ w.astype(np.float32), unlabelled @ w.astype(np.float32)
        sp, su = sigmoid(zp), sigmoid(zu)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = prior * (positive.T @ ((sp - 1).astype(np.float32))) / len(zp)
        down = unlabelled.T @ su.astype(np.float32) / len(zu) - prior * (positive.T @ sp.astype(np.float32)) / len(zp)
        grad = (up + down if rest >= 0 else -down) + decay * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Fit(w, prior)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _sampled(docs: DataFrame, marked: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the positives and of unlabelled documents."""
    total = docs.count()
    share = min(1.0, sample / max(1, total))
    chosen = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    x = docs.select("doc_id", "text").join(F.broadcast(marked.select(F.col("doc_id").alias("p_id"))), F.col("doc_id") == F.col("p_id"), "left")
    x = x.select("text", F.col("p_id").isNotNull().alias("p"), (chosen & ~held_out()).alias("u")).where("p or u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f = features(*buffers(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in f], pa.binary())], names=["p", "u", "f"])

    rows = x.mapInArrow(tidy(run), "p boolean, u boolean, f binary").collect()
    rows.sort(key=lambda r: bytes(r["f"]))  # the fit must not depend on the order of arrival
    of = lambda k: np.frombuffer(b"".join(bytes(r["f"]) for r in rows if r[k]), np.float32).reshape(-1, DIMS)
    return of("p"), of("u")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fit:
    """A model from the labels that are not held out."""
    known = labels.where(~held_out()).where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    prior = known.agg(F.avg("quality").alias("q")).first()["q"]
    prior = min(0.95, max(0.05, 0.5 if prior is None else float(prior)))
    positives = known.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64(F.lit("positive"), "doc_id"), "doc_id").limit(sample)
    p, u = _sampled(docs, positives, sample)
    return fit(p, u, prior)


def scored(docs: DataFrame, model: Fit) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    x = docs.select("doc_id", "text")
    kind = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = model.scores(features(*buffers(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = x.mapInArrow(tidy(run), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
