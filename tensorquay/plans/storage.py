"""Queries on anchors, snapshots, reserved weights, payload bits and checks of stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import CEILINGS, FILES, RUNS, ceilings, files, runs, weights
from ..functions import quant as Q
from ..functions import records as R
from ..operators import intervals as I
from ..operators import ranking as K
from ..operators import trees as T
from ..operators.content import Snapshots
from ..registry import query, table
from ..session import scratch_folder
from .trees import _ENTRIES


@query(
    "df19_newest_valid_anchor",
    """with a as (select o_custkey as id, o_orderkey as generation, o_orderkey % 5 = 0 as broken from orders)
    select id, max(generation) filter (where not broken) as generation from a group by id having count(*) filter (where not broken) > 0""",
)
def df19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor slots packed with their checksum, some with a flipped byte; the newest valid one counts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("generation"))
    pointer = R.packed_pointer(F.lit(1), F.col("generation") % 1000, F.lit(4096), F.lit(0))
    raw = o.select("id", "generation", R.packed_anchor(F.col("generation"), pointer).alias("raw"))
    byte = F.conv(F.hex(F.substring("raw", 11, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(0xEE))
    flipped = F.concat(F.substring("raw", 1, 10), F.unhex(F.lpad(F.hex(byte), 2, "0")), F.expr("substring(raw, 12, 17)"))
    x = raw.select("id", R.unpacked_anchor(F.when(F.col("generation") % 5 == 0, flipped).otherwise(F.col("raw"))).alias("a"))
    return x.where("a is not null").groupBy("id").agg(F.max("a.generation").alias("generation"))


@query(
    "df20_init_free_runs",
    f"""with {CEILINGS}, low as (select slot, weight, ceiling as key, 8 as bits from ceilings order by ceiling, slot, weight limit 512),
    u as (select *, sum(bits) over (order by key, slot, weight) as up from low), taken as (select slot, weight from u where up - bits < 512),
    r as (select slot, min(weight) as a, max(weight) as b from weights group by slot)
    select r.slot, r.b - r.a + 1 - count(t.weight) as free_weights from r left join taken t on t.slot = r.slot group by r.slot, r.a, r.b""",
)
def df20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each slot, less the weights that hold the anchor."""
    w = weights(spark, sf_dir)
    whole = w.groupBy("slot").agg(F.min("weight").alias("start"), (F.max("weight") - F.min("weight") + 1).alias("length"))
    taken = K.anchor_placement(ceilings(spark, sf_dir)).select("slot", F.col("weight").alias("start"), F.lit(1).cast("long").alias("length")).distinct()
    return I.subtracted(whole, taken).groupBy("slot").agg(F.sum("length").alias("free_weights"))


@query("df18_commit_snapshot", f"with {FILES} select path, length(content)::int as n from files where doc_id % 2 = 0")
def df18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations committed; the newest one is read back."""
    s = Snapshots(spark, f"{scratch_folder(spark)}/tensorquay/snapshots-{uuid.uuid4().hex}")
    f = files(spark, sf_dir).select("doc_id", "path", F.length("content").alias("n"))
    first = s.commit({"files": f.drop("doc_id")})
    s.commit({"files": f.where("doc_id % 2 = 0").drop("doc_id")}, expected=first)
    return s.read("files")


@query("df9_allocate_preferring_dirty")
def df9(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("pool"), F.col("s_suppkey").alias("req"), (F.col("s_suppkey") * 37 % 500 + 1).alias("bits"))
    r = runs(spark, sf_dir).withColumn("pool", F.col("slot").cast("long")).withColumn("dirty", F.when(F.col("start") % 3 == 0, F.col("length")).otherwise(0))
    return I.allocate(req, r, 8)


@query(
    "df26_clean_targets_only",
    """with t as (select l_partkey % 50 as region, l_orderkey * 8 + l_linenumber as bit from lineitem), dirty as (select o_orderkey * 9 as bit from orders),
    m as (select region, count(*) as targets, count(*) filter (where bit in (select bit from dirty)) as dirty from t group by region) select region, targets, dirty = 0 as allowed from m""",
)
def df26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose targets hold no written weight; checked before anything is changed."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("region"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("bit"))
    dirty = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 9).alias("d_bit")).distinct()
    x = t.join(dirty, F.col("bit") == F.col("d_bit"), "left")
    return x.groupBy("region").agg(F.count(F.lit(1)).alias("targets"), (F.count("d_bit") == 0).alias("allowed"))


@query("snk4_directory_records", f"with {_ENTRIES} select parent, count(*) as n, string_agg(name, '|' order by name) as names from adj group by parent")
def snk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.adjacency(T.from_files(files(spark, sf_dir)))
    return x.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names"))


@query(
    "snk8_salience_checks",
    """with s as (select label as slot, vec_id, embedding as period from embeddings), f as (select slot, vec_id, case when len(period) = 0 then 'empty' when not list_bool_and(list_transform(period, lambda x: isfinite(x))) then 'not_finite'
      when list_min(period) < 0 then 'negative' else 'valid' end as verdict from s) select slot, verdict, count(*) as n from f group by all""",
)
def snk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A salience table's rows by the constraint that they break."""
    finite = F.forall("period", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    verdict = F.when(F.size("period") == 0, "empty").when(~finite, "not_finite").when(F.array_min("period") < 0, "negative").otherwise("valid")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("slot"), F.col("embedding").alias("period")).groupBy("slot", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_KINDS = "['F32', 'F16', 'Q8_0', 'Q3_K', 'Q4_K', 'Q5_K', 'Q6_K']"


@query("fn16_payload_round_trip", f"select o_orderkey, {_KINDS}[o_orderkey % 7 + 1] as kind, true as same, true as others_kept from orders")
def fn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload bits written into pseudo-random blocks and read back; all other bits stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = ["F32", "F16", "Q8_0", "Q3_K", "Q4_K", "Q5_K", "Q6_K"]
        per = {"F32": 8, "F16": 4, "Q8_0": 4, "Q3_K": 1, "Q4_K": 1, "Q5_K": 1, "Q6_K": 2}
        for pdf in batches:
            out = []
            for key in pdf["o_orderkey"]:
                kind = kinds[key % 7]
                n = {"F32": 1, "F16": 1, "Q8_0": 32}.get(kind, 64)
                rng = np.random.default_rng(key)
                block, payload = rng.bytes(Q.BLOCK_BYTES[kind]), rng.bytes(-(-n * per[kind] // 8))
                bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[: n * per[kind]].tolist()  # noqa: B023, E731
                new = Q.write_bits(kind, block, range(n), per[kind], payload)
                back = Q.write_bits(kind, new, range(n), per[kind], Q.read_bits(kind, block, range(n), per[kind]))
                out.append((key, kind, bits(Q.read_bits(kind, new, range(n), per[kind])) == bits(payload), back == block))
            yield pd.DataFrame(out, columns=["o_orderkey", "kind", "same", "others_kept"])

    return table(spark, sf_dir, "orders").select("o_orderkey").mapInPandas(run, "o_orderkey long, kind string, same boolean, others_kept boolean")


@query("fn4_to_7_block_quants")
def fn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every block type, made of digests, decoded by the Arrow UDF."""
    kinds = F.array(*(F.lit(k) for k in ("Q8_0", "Q3_K", "Q4_K", "Q5_K", "Q6_K")))
    sizes = F.create_map(*(F.lit(x) for k in ("Q8_0", "Q3_K", "Q4_K", "Q5_K", "Q6_K") for x in (k, Q.BLOCK_BYTES[k])))
    # digits 1..9 only, so that no half-float scale is infinite or not a number
    text = F.translate(F.concat(*(F.sha2(F.concat_ws("-", F.col("p_partkey").cast("string"), F.lit(str(i))), 512) for i in range(3))), "0abcdef", "1234567")
    x = table(spark, sf_dir, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("kind"), text.alias("t"))
    x = x.withColumn("raw", F.expr("substring(cast(t as binary), 1, 210)")).withColumn("raw", F.substring("raw", F.lit(1), sizes[F.col("kind")]))
    w = x.select("p_partkey", "kind", Q.dequantize(F.col("kind"), F.col("raw")).alias("w"))
    return w.select("p_partkey", "kind", F.size("w").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda a, v: a + v.cast("double")), 2).alias("total"))


def lossy(raw: Column) -> Column:
    """Bytes as text; those that are no character become a mark."""

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return decoded(raw)


@query("fn34_lossy_text")
def fn34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of each file as text."""
    return files(spark, sf_dir).select("doc_id", lossy(F.col("content").cast("binary")).alias("text"))


@query("df15_bitmap_chunks", f"with {RUNS} select count(*) as runs, sum(length)::bigint as bits from runs")
def df15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmap pages written to a snapshot and loaded again; runs do not overlap, so bits add up."""
    from ..operators import bitmaps as B

    r = runs(spark, sf_dir)
    bits = r.select(F.explode(F.expr("sequence(start * 8 + slot, start * 8 + slot + length - 1)")).alias("bit"))
    s = Snapshots(spark, f"{scratch_folder(spark)}/tensorquay/snapshots-{uuid.uuid4().hex}")
    s.commit({"bitmap": B.marked(bits)})
    return s.read("bitmap").agg(F.sum(F.bitmap_count("bits")).alias("bits")).crossJoin(r.agg(F.count(F.lit(1)).alias("runs"))).select("runs", "bits")
