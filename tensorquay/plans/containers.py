"""Queries on containers: each supplier becomes one, is parsed again, and its tables are queried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import container as C


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, nation in zip(pdf["s_suppkey"], pdf["s_nationkey"]):
                pairs = [("general.architecture", 8, "llama"), ("llama.block_count", 4, int(nation) + 1), ("llama.embedding_length", 4, 64), ("llama.attention.head_count", 4, 4), ("tokenizer.ggml.tokens", 9, (8, ["a", f"t{key}"])), ("tokenizer.ggml.token_type", 9, (5, [1, 3])), ("tokenizer.ggml.merges", 9, (8, ["a b"]))]
                half = (np.arange(32) + key).astype("<f2").tobytes()
                q8 = b"".join(np.float16(0.5).tobytes() + np.arange(-16, 16, dtype=np.int8).tobytes() for _ in range(int(nation) + 1))
                out.append((f"s{key}.gguf", C.build(pairs, [("blk.0.attn_q.weight", [32], 1, half), ("blk.0.ffn_up.weight", [32, int(nation) + 1], 8, q8)])))
            yield pd.DataFrame(out, columns=["path", "content"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").mapInPandas(run, "path string, content binary")


@query("src2_container_headers", "select 's' || s_suppkey || '.gguf' as path, 3 as version, 32::bigint as alignment, 7 as n_pairs, 2 as n_tensors from supplier")
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C.headers_of(_files(spark, sf_dir)).where("error is null")
    return h.select("path", "version", "alignment", F.size("pairs").alias("n_pairs"), F.size("tensors").alias("n_tensors"))


@query("src3_key_values", "select 's' || s_suppkey || '.gguf' as path, (s_nationkey + 1)::varchar as value from supplier")
def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pair_value(C.pairs(C.headers_of(_files(spark, sf_dir))), "llama.block_count")


@query("src4_tokenizer_keys", "select k as key, count(*) as n from supplier, (select unnest(['tokenizer.ggml.tokens', 'tokenizer.ggml.token_type', 'tokenizer.ggml.merges']) as k) group by k")
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokenizer_pairs(C.pairs(C.headers_of(_files(spark, sf_dir)))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("src6_dequantized_rows", """select 's' || s_suppkey || '.gguf' as path, 'F16' as type, 32 as n, (32 * s_suppkey + 496)::double as total from supplier
  union all select 's' || s_suppkey || '.gguf', 'Q8_0', 32 * (s_nationkey + 1), -8.0 * (s_nationkey + 1) from supplier""")
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    w = C.decoded_tensors(f, C.headers_of(f))
    return w.select("path", "type", F.size("weights").alias("n"), F.aggregate("weights", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("src8_model_config", "select 's' || s_suppkey || '.gguf' as path, s_nationkey + 1 as layers, 4 as kv_heads, 16 as rope_width, 10000.0::double as rope_base, 0 as context from supplier")
def src8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.model_config(C.pairs(C.headers_of(_files(spark, sf_dir)))).select("path", "layers", "kv_heads", "rope_width", "rope_base", "context")


@query("src9_vocabulary", "select 's' || s_suppkey || '.gguf' as path, 0 as id, 'a' as token, 1 as type from supplier union all select 's' || s_suppkey || '.gguf', 1, 't' || s_suppkey, 3 from supplier")
def src9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vocabulary(C.pairs(C.headers_of(_files(spark, sf_dir))))


@query("src12_inspect", "select 'general.architecture' as key, '\"llama\"' as value, count(*) as n from supplier")
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = C.pairs(C.headers_of(_files(spark, sf_dir)))
    return kv.where("key = 'general.architecture'").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query("df3_chunk_read", """with n as (select l_orderkey as chunk, l_linenumber - 1 as ordinal, max((l_quantity::int * 7 + l_linenumber * 31) % 16) as nibble from lineitem group by all)
  select chunk, ordinal // 2 as byte, sum(nibble * (1 << (4 * (ordinal % 2))::int))::bigint as value from n group by 1, 2""")
def df3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four payload bits of each weight of a run, two weights to a byte, low half first."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), (F.col("l_linenumber") - 1).alias("ordinal"), ((F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber") * 31) % 16).alias("nibble"))
    n = x.groupBy("chunk", "ordinal").agg(F.max("nibble").alias("nibble"))
    return n.groupBy("chunk", F.expr("ordinal div 2").cast("int").alias("byte")).agg(F.sum(F.expr("shiftleft(cast(nibble as bigint), 4 * (ordinal % 2))")).alias("value"))


@query("df4_chunk_write_deltas", """with w as (select l_orderkey, l_linenumber, ((l_quantity::int * 7 + l_linenumber * 31) % 256) as q, (l_partkey % 16)::int as payload, l_discount + 0.01 as scale from lineitem),
  d as (select *, (q & 240) | payload as after from w) select l_orderkey, l_linenumber, payload, round(((case when after >= 128 then after - 256 else after end) - (case when q >= 128 then q - 256 else q end)) * scale, 6) as delta from d""")
def df4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload bits written into the low bits of signed bytes, and what each weight's value changed by."""
    q = ((F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber") * 31) % 256).alias("q")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q, (F.col("l_partkey") % 16).cast("int").alias("payload"), (F.col("l_discount") + 0.01).alias("scale"))
    x = x.withColumn("after", F.col("q").bitwiseAND(240).bitwiseOR(F.col("payload")))
    signed = lambda c: F.when(F.col(c) >= 128, F.col(c) - 256).otherwise(F.col(c))
    return x.select("l_orderkey", "l_linenumber", "payload", F.round((signed("after") - signed("q")) * F.col("scale"), 6).alias("delta"))


@query("jn11_factor_lookup", """with r as (select distinct (l_suppkey % 2)::int as layer, l_partkey % 50 as out_channel from lineitem), f as (select unnest([0, 1])::int as layer, unnest([576, 1536]) as n)
  select r.layer, r.out_channel, f.n from r join f on f.layer = r.layer""")
def jn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions joined to their layer's factor; a region without one would be an error before any write."""
    r = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 2).cast("int").alias("layer"), (F.col("l_partkey") % 50).alias("out_channel")).distinct()
    f = spark.createDataFrame([(0, 576), (1, 1536)], "layer int, n int")
    missing = F.when(F.col("n").isNull(), F.raise_error(F.lit("a region has no factor"))).otherwise(F.col("n"))
    return r.join(F.broadcast(f), "layer", "left").select("layer", "out_channel", missing.alias("n"))


def _decoder():
    from ..functions.tensor import Decoder

    rng = np.random.default_rng(7)
    d, f, v = 16, 32, 32
    w = {"token_embd": rng.normal(size=(v, d)).astype(np.float32), "output_norm": np.ones(d, np.float32)}
    for i in range(2):
        for name, shape in (("attn_q", (d, d)), ("attn_k", (8, d)), ("attn_v", (8, d)), ("attn_output", (d, d)), ("ffn_gate", (f, d)), ("ffn_up", (f, d)), ("ffn_down", (d, f))):
            w[f"blk.{i}.{name}"] = (rng.normal(size=shape) * 0.2).astype(np.float32)
        w[f"blk.{i}.attn_norm"] = w[f"blk.{i}.ffn_norm"] = np.ones(d, np.float32)
    return Decoder(w, heads=4, kv_heads=2, context=2**31 - 1)  # turns are read whole, however long


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    tokens = F.transform(F.filter(F.split("text", r"[ \t\n]+"), lambda w: w != ""), lambda w: F.length(w) % 32)
    return c.select("conv_id", "turn", tokens.alias("tokens")).where("size(tokens) >= 2")


@query("df22_forward_pass")
def df22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next token a small decoder finds likeliest, and the perplexity of the turn (windows of 64)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _decoder()
        for pdf in batches:
            out = []
            for c, t, tokens in zip(pdf["conv_id"], pdf["turn"], pdf["tokens"]):
                ids = np.asarray(tokens, np.int64)
                out.append((c, t, int(model.read(ids).argmax()), round(model.perplexity(ids, 64), 3)))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "token", "perplexity"])

    return _sequences(spark, sf_dir).mapInPandas(run, "conv_id long, turn long, token int, perplexity double")


@query("df24_calibrate")
def df24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel salience of every tensor, from the activations that a forward pass gives."""
    from ..operators.calibration import to_tensors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, sums = _decoder(), {}

        def observe(site: str, layer: int, x: np.ndarray) -> None:
            s = sums.setdefault((site, layer), [np.zeros(x.shape[1]), 0])
            s[0] += np.abs(x).sum(axis=0)
            s[1] += len(x)

        for pdf in batches:
            for tokens in pdf["tokens"]:
                model.read(np.asarray(tokens, np.int64), observe=observe)
        rows = [(site, layer, c, v, n) for (site, layer), (total, n) in sums.items() for c, v in enumerate(total.tolist())]
        yield pd.DataFrame(rows, columns=["site", "layer", "channel", "total", "tokens"])

    parts = _sequences(spark, sf_dir).mapInPandas(run, "site string, layer int, channel int, total double, tokens long")
    by = parts.groupBy("site", "layer", "channel").agg((F.sum("total") / F.sum("tokens")).alias("salience"))
    return to_tensors(by).select("tensor", "channel", F.round("salience", 4).alias("salience"))
