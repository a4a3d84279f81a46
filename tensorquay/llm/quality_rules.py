"""Quality rules with adaptive thresholds (operator 10).

Each document gets counts and, from these, ratios to its number of words.  A mergeable quantile sketch of
each ratio is kept for each language and source (integer histograms whose buckets grow with the value, so
sketches merge by adding counts and every rerun gives the same quantiles).  Only documents that pass the
base rule enter, as the others are rejected anyway.  Cutoffs are fences that the sketch's quartiles set, on
a scale of factors: the third quartile times a power of its factor to the first.  Counts go up by one
before they are divided, so a ratio that is mostly nothing still spreads with the lengths of its group's
texts.  Small groups use the merged sketch of their language, then of all documents.  The filter is a join
of the documents with their group's fences.

Defined cases: a null or empty text has no words and is rejected by the base rule; null languages
and sources are groups like any others; ties stand on one side of a fence; repeated rows are judged one by
one; texts are read whole, however long; an empty table gives an empty table; other columns of the input
do not matter, whatever their names (``with_counts`` puts its own in place of such as have their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written
from .text_kernels import SPACE, U, Words, buffers, grams, mix, slices, span_hashes, tidy

#: ratio -> (count, power of the factor between the quartiles, in halves); capitals and words that
#: come again vary more in good text.
RATIOS = {
    "r_symbols": ("n_symbols", 5),
    "r_bangs": ("n_bangs", 5),
    "r_upper": ("n_upper", 7),
    "r_repeat": ("n_repeat_words", 7),
    "r_dup_lines": ("n_dup_lines", 5),
}
#: Ratios are per so many words.
PER = 1_000_000
#: The factor between the quartiles counts as this at least: a guard for groups of almost equal texts.
LEAST_FACTOR = 1.25
#: Groups with fewer documents take their language's sketch, then that of all documents.
LEAST_GROUP = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(b: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts, and some more, of each document of a slice."""

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    w = Words(b, offs)
    chars = ~SPACE[b] & ((b & 0xC0) != 0x80)
    out = {"n_words": w.count.astype(np.int64), "word_chars": per_doc(chars), "n_symbols": per_doc(_SYMBOL[b])}
    docs = len(offs) - 1
    # words in windows of three that come twice or more in their document
    doc = w.doc.astype(U)
    g = grams(w.hash, 3)
    inside = doc[: len(g)] == doc[2:] if len(g) else np.zeros(0, bool)
    key = mix(g ^ mix(doc[: len(g)] + U(7)))
    s = np.sort(key[inside])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    hit = np.zeros(len(w.hash), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        found = np.flatnonzero((twice[at] == key) & inside)
        for j in range(3):
            hit[found + j] = True
    out["n_repeat_words"] = np.bincount(doc[hit].astype(np.int64), minlength=docs).astype(np.int64)
    # lines with a word that equal an earlier line of the document
    breaks = np.flatnonzero(b == 10)
    start = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    start = start[start < len(b)] if len(b) else start[:0]
    stop = np.searchsorted(breaks, start)
    stop = np.where(stop < len(breaks), breaks[np.minimum(stop, max(len(breaks) - 1, 0))], len(b)) if len(breaks) else np.full(len(start), len(b))
    line_doc = np.searchsorted(offs, start, "right") - 1
    stop = np.minimum(stop, offs[line_doc + 1])
    words = np.zeros(len(b) + 1, np.int64)
    np.cumsum(~SPACE[b], out=words[1:])
    full = words[stop] > words[start]
    start, stop, line_doc = start[full], stop[full], line_doc[full]
    key = mix(span_hashes(b, start, stop) ^ mix(line_doc.astype(U) + U(11)))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    out["n_lines"] = np.bincount(line_doc, minlength=docs).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=docs).astype(np.int64)
    out["n_bangs"] = per_doc(b == 33)
    out["n_upper"] = per_doc((b >= 65) & (b <= 90))
    return out


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns COUNTS beside its own, or in place of its own of these names."""
    df = df.drop(*COUNTS)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = counts(*buffers(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c]) for c in COUNTS)], names=[*part.schema.names, *COUNTS])

    return df.mapInArrow(tidy(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(name: str) -> Column:
    return F.expr(f"greatest(({RATIOS[name][0]} + 1) * {PER} div greatest(n_words, 1), 1)")


def bucket(x: Column) -> Column:
    """The sketch's bucket of a whole number: exact below 64, then 32 buckets for each doubling."""
    shift = F.greatest(F.lit(0), F.length(F.bin(x)) - 6).cast("long")
    return F.when(x < 64, x).otherwise(shift * 32 + F.floor(x / F.pow(F.lit(2.0), shift)).cast("long"))


def bucket_value(k: Column) -> Column:
    """The least number of a bucket."""
    shift = F.greatest(F.lit(0), F.floor(k / 32) - 1)
    return F.when(k < 64, k.cast("double")).otherwise((k - shift * 32) * F.pow(F.lit(2.0), shift))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): one mergeable sketch for each language, source and ratio."""
    judged = counted.where(~base_failed()).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), bucket(_ratio(r)).alias("bucket")) for r in RATIOS))).alias("x"))
    return judged.groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Total, first and third quartile of each merged sketch; exact up to a bucket's width."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    by = [*keys, "ratio"]
    up_to = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = merged.select("*", F.sum("n").over(up_to).alias("up"), F.sum("n").over(W.partitionBy(*by)).alias("total"))
    at = lambda q: bucket_value(F.min(F.when(F.col("up") >= q * F.col("total"), F.col("bucket"))))
    return ranked.groupBy(*by).agg(F.max("total").alias("total"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def power(factor: Column, halves: int) -> Column:
    """``factor ** (halves / 2)`` by products and a root, which every engine rounds alike."""
    out = F.sqrt(factor) if halves % 2 else F.lit(1.0)
    for _ in range(halves // 2):
        out = out * factor
    return out


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each language and source: the upper fence of each ratio."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("ratio").alias("l_ratio"), *(F.col(c).alias("l_" + c) for c in ("total", "q1", "q3")))
    every = quartiles(sketch, []).select(F.col("ratio").alias("a_ratio"), *(F.col(c).alias("a_" + c) for c in ("q1", "q3")))
    x = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("ratio") == F.col("l_ratio")), "left").join(every, F.col("ratio") == F.col("a_ratio"), "left")
    pick = lambda q: F.when(F.col("total") >= LEAST_GROUP, F.col(q)).when(F.col("l_total") >= LEAST_GROUP, F.col("l_" + q)).otherwise(F.col("a_" + q))
    x = x.select("lang", "source", "ratio", pick("q3").alias("q3"), F.greatest(pick("q3") / pick("q1"), F.lit(LEAST_FACTOR)).alias("factor"))
    return x.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == r, F.floor(F.col("q3") * power(F.col("factor"), halves)))).alias("f" + r[1:]) for r, (_, halves) in RATIOS.items()))


def judged(counted: DataFrame, fence: DataFrame) -> DataFrame:
    """``counted`` with base_failed, its group's fences and kept."""
    f = fence.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    x = counted.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_lang", "f_source")
    inside = F.lit(True)
    for r in RATIOS:
        inside = inside & (F.coalesce(_ratio(r) <= F.col("f" + r[1:]), F.lit(True)))
    return x.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, lang, source, the counts, the fences, base_failed, kept."""
    counted = written(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-counts")
    return judged(counted, fences(sketches(counted)))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    names = docs.columns
    slim = docs.select("text", "lang", "source")
    fence = written(fences(sketches(with_counts(slim).drop("text"))), "quality-fences")
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), "text", "lang", "source")
    passed = judged(with_counts(inner), fence).where("kept")
    return passed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source", *("f" + r[1:] for r in RATIOS))
