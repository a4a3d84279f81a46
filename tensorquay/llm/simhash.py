"""Document fingerprints: SimHash (operator 9).

Every occurrence of a term votes with the signs of its hash's bits; a fingerprint bit is the sign of
the sum.  Terms are pairs of neighbouring words (with marks for the text's ends), so texts of one
language differ although they share their frequent words.  ``near`` finds, for the fingerprints that are
asked for, all others within a Hamming radius by permuted block tables: the bits are cut into blocks, some
radius-many of which can hold all the differences, so every choice of the others is a table whose key
must be equal; each pair is kept at the first table in which it meets.  Keys that many fingerprints share
are dealt over blocks, and a filter of fixed size spares the shuffle of those that no question shares.

Defined cases: a null or empty text has no terms and the fingerprint of all zeros, like any text
without words; equal texts have equal fingerprints; texts are read whole, however long; rows are in the
order of doc_id, a number (null first), then of the text, and rows of one doc_id are read by one task; an
empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import hit_filter, with_hit
from .scratch import written
from .text_kernels import U, Words, buffers, grams, mix, seeds, tidy

#: Bits of a fingerprint (a multiple of 64).
BITS = 128
#: Bits in which a near fingerprint may differ.
RADIUS = 3
#: Fingerprints that one block of a key holds.
KEY_BLOCK = 2048
_LANES = seeds(16, 20_000)
_END = seeds(2, 21_000)


def fingerprints(b: np.ndarray, offs: np.ndarray, bits: int = BITS) -> list[str]:
    """The fingerprint of each document of a slice, in hexadecimal."""
    w = Words(b, offs, lower=True)
    h, lanes, out = w.hash, bits // 64, []
    for first, n in zip(w.first[:-1].tolist(), w.count.tolist()):
        if not n:
            out.append("0" * (bits // 4))
            continue
        g = grams(np.concatenate([_END[:1], h[first : first + n], _END[1:]]), 2)
        votes = np.zeros(bits, np.int64)
        for at in range(0, len(g), 8192):
            part = np.stack([mix(g[at : at + 8192] + _LANES[j]) for j in range(lanes)], axis=1)
            ones = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1)
            votes += 2 * ones.sum(axis=0, dtype=np.int64) - len(part)
        out.append(np.packbits(votes > 0).tobytes().hex())
    return out


def of_texts(texts: list[str], bits: int = BITS) -> list[str]:
    return fingerprints(*buffers(pa.array(texts, pa.large_string())), bits)


def likeness(a: str, b: str) -> float:
    """1 less the share of bits that differ."""
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / (4 * len(a)) if a else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def ranges(docs: DataFrame, count: int) -> list:
    """Ends of about ``count`` ranges of doc_id with like numbers of rows; a short list for the driver."""
    q = [(i + 1) / count for i in range(count - 1)]
    got = docs.agg(F.percentile_approx("doc_id", q, 10_000).alias("q")).first()["q"] if q else None
    return sorted(set(got or []))


def _place(doc_id: Column, ends: list) -> Column:
    """The range of a doc_id: the number of ends below it; null stands in the first."""

    @F.pandas_udf("int")
    def place(ids: pd.Series, none: pd.Series) -> pd.Series:
        return pd.Series(np.where(none, 0, np.searchsorted(ends, ids)), dtype="int32")

    return place(F.coalesce(doc_id, F.lit(0)), doc_id.isNull())


def _places(doc_id: Column, ends: list, firsts: list[tuple]) -> Column:
    """Twice the range of a doc_id, and for the first of a range also twice the range before it and one more."""
    before = {(doc, place): firsts[i - 1][0] for i, (place, doc) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, none: pd.Series) -> pd.Series:
        own = np.where(none, 0, np.searchsorted(ends, ids)).tolist()
        back = [before.get((None if x else i, p)) for i, x, p in zip(ids.tolist(), none.tolist(), own)]
        return pd.Series([[2 * p] if b is None else [2 * p, 2 * b + 1] for p, b in zip(own, back)])

    return places(F.coalesce(doc_id, F.lit(0)), doc_id.isNull())


def neighbours(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Each row beside the next one in order (after the last: the first): fingerprints and likeness.

    Rows are dealt by ranges of doc_id, each range is sorted and read as a stream; the first row of a
    range also goes, as a guest, to the range before it.
    """
    spark = docs.sparkSession
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ends = ranges(x.select("doc_id"), 3 * parts)
    own = _place(F.col("doc_id"), ends)
    heads = x.select(own.alias("place"), "doc_id").where("doc_id is not null").groupBy("place").agg(F.min("doc_id").alias("first")).collect()  # one row for each range
    no_id = x.where("doc_id is null").limit(1).count() > 0  # such rows come first
    firsts = sorted([(r["place"], r["first"]) for r in heads if not (no_id and r["place"] == 0)] + [(0, None)] * no_id)
    dealt = x.select("doc_id", "text", F.explode(_places(F.col("doc_id"), ends, firsts)).alias("to")).select(F.expr("to div 2").alias("place"), F.expr("to % 2").alias("guest"), "doc_id", "text")
    kind = x.schema["doc_id"].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(doc_id, text, next text) of own rows; of a range's guests only the first is used."""
        last = first = None
        for batch in batches:
            for p, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last is not None and last[0] == p:
                    yield last[1], last[2], text
                    last = None
                elif last is not None:
                    yield last[1], last[2], ""
                    last = None
                if not guest:
                    last = (p, doc, text)
        if last is not None:
            yield last[1], last[2], ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            texts = [r[1] for r in held]
            nexts = [r[2] for r in held]
            news = [edited(t, f) for t, f in zip(texts, nexts)]
            # the next text is mostly the next row's own
            same = [i + 1 < len(texts) and nexts[i] is texts[i + 1] for i in range(len(texts))]
            all_of = of_texts(texts + news + [n for n, s in zip(nexts, same) if not s], bits)
            a, e, rest = all_of[: len(texts)], all_of[len(texts) : 2 * len(texts)], iter(all_of[2 * len(texts) :])
            f = [a[i + 1] if s else next(rest) for i, s in enumerate(same)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], doc_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in news]), pa.array(a), pa.array(e), pa.array([likeness(p, q) for p, q in zip(a, e)]), pa.array([likeness(p, q) for p, q in zip(a, f)])],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal doc_type
            for batch in source:
                doc_type = batch.schema.field(2).type
                yield batch

        doc_type = pa.int64()
        for row in pairs(typed(batches)):
            held.append(row)
            size += len(row[1])
            if size > 1 << 19:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    # a guest sorts after all own rows of its range, whatever its doc_id
    sorted_rows = dealt.repartition(F.col("place")).sortWithinPartitions("place", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return sorted_rows.mapInArrow(tidy(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near(prints: DataFrame, asked: DataFrame | None = None, radius: int = RADIUS, blocks: int | None = None, bits: int = BITS, fingerprint: str = "fingerprint") -> DataFrame:
    """(a, b, distance): each different fingerprint a of ``asked`` and all others b of ``prints`` that
    differ from it in at most ``radius`` bits; without ``asked``, all pairs a < b.

    Equal fingerprints are one row here; with ``blocks`` blocks there are C(blocks, radius) tables,
    each keyed by the blocks - radius blocks left out of a choice.
    """
    n = blocks or radius + 2
    digits = bits // 4
    cut = [i * digits // n for i in range(n + 1)]
    part = lambda c, j: F.substring(c, cut[j] + 1, cut[j + 1] - cut[j])
    tables = list(combinations(range(n), n - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias(name)).distinct()
        return one.select(name, F.posexplode(F.array(*(F.xxhash64(F.lit(i), *(part(name, j) for j in c)) for i, c in enumerate(tables)))).alias("table", "key"))

    def dealt(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """Rows in their own block of a key, one for each block of the other side."""
        x = df.join(blocked, ["table", "key"]).withColumn(own, F.pmod(F.xxhash64(name), F.col(f"n_{own}")))
        return x.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1))).select(name, "table", "key", "at_a", "at_b")

    a, b = keyed(prints if asked is None else asked, "a"), keyed(prints, "b")
    if asked is not None:
        pages = written(hit_filter(a, F.col("key")), "filter")
        b = with_hit(b, F.col("key"), pages).where("filter_hit").drop("filter_hit")
    a, b = written(a, "asked"), written(b, "keyed")
    count = lambda df, name: df.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / KEY_BLOCK).cast("long").alias(name))
    blocked = written(count(a, "n_at_a").join(count(b, "n_at_b"), ["table", "key"]), "blocked")
    halves = [(i * 8 + 1, min(8, digits - i * 8)) for i in range((digits + 7) // 8)]
    word = lambda c, at, m: F.conv(F.substring(c, at, m), 16, 10).cast("long")
    distance = sum((F.bit_count(word("a", at, m).bitwiseXOR(word("b", at, m))) for at, m in halves), F.lit(0))
    first = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        meets = F.lit(True)
        for j in tables[t]:
            meets = meets & (part("a", j) == part("b", j))
        first = F.when(meets, t).otherwise(first)
    y = dealt(b, "b", "at_b", "at_a").withColumnsRenamed({c: f"b_{c}" for c in ("table", "key", "at_a", "at_b")})
    same = (F.col("a") < F.col("b")) if asked is None else (F.col("a") != F.col("b"))
    for c in ("table", "key", "at_a", "at_b"):
        same = same & (F.col(c) == F.col(f"b_{c}"))
    pairs = dealt(a, "a", "at_a", "at_b").join(y, same & (distance <= radius) & (F.col("table") == first))
    return pairs.select("a", "b", distance.cast("int").alias("distance"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the fixed columns, n_near: for documents whose doc_id is divisible by 50, the number of all
    others whose fingerprints differ from theirs in at most RADIUS bits; null for the rest."""
    found = written(neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    asked = found.where("doc_id % 50 = 0").select("fingerprint").distinct()
    copies = found.groupBy(F.col("fingerprint").alias("c_print")).agg(F.count(F.lit(1)).alias("copies"))
    others = near(found, asked).join(copies, F.col("b") == F.col("c_print")).groupBy("a").agg(F.sum("copies").alias("others"))
    of = written(asked.join(copies, F.col("fingerprint") == F.col("c_print")).join(others, F.col("fingerprint") == F.col("a"), "left").select(F.col("fingerprint").alias("a_print"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")), "near")
    x = found.join(of, (F.col("doc_id") % 50 == 0) & (F.col("fingerprint") == F.col("a_print")), "left")
    return x.select(*found.columns, "n_near")
