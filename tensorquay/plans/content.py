"""Queries on contents: chunks, storing once, snapshots as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import FILES, files
from ..functions.chunking import Params
from ..operators import content as C
from ..registry import query, table

SMALL = Params(64, 256, 1024)


@query("df1_content_chunks")
def df1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunked(files(spark, sf_dir), SMALL).select("path", "place", "start", "length", "digest")


@query("df14_store_and_load", f"with {FILES} select path, strlen(content)::bigint as bytes, sha256(content) as digest from files where content <> ''")
def df14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut into chunks and put together again; the digests must be those of the files."""
    x = C.loaded(C.chunked(files(spark, sf_dir), SMALL))
    return x.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query("df5_chunks_to_write")
def df5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunks of odd documents when the even ones are stored already."""
    f = files(spark, sf_dir)
    known = C.chunked(f.where("doc_id % 2 = 0"), SMALL).select("digest").distinct()
    return C.stored(C.chunked(f.where("doc_id % 2 = 1"), SMALL).select("digest", "length"), known)


_KNOWN = f"{FILES}, known as (select distinct sha256(content) as digest from files where doc_id % 2 = 0)"


@query("jn8_dedup_semi_anti", f"with {_KNOWN} select f.doc_id, sha256(content) as digest, k.digest is null as was_new from files f left join known k on k.digest = sha256(content) where doc_id % 2 = 1")
def jn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("digest"))
    return C.outcomes(x.where("doc_id % 2 = 1"), x.where("doc_id % 2 = 0"))


@query("df6_stored_once", f"with {_KNOWN} select sha256(content) as digest, strlen(content)::bigint as length, count(*) as copies from files where doc_id % 2 = 1 and sha256(content) not in (select digest from known) group by 1, 2")
def df6(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("length"))
    new = x.where("doc_id % 2 = 1").join(x.where("doc_id % 2 = 0").select("digest"), "digest", "left_anti")
    return new.groupBy("digest", "length").agg(F.count(F.lit(1)).alias("copies"))


@query("agg16_dedup_index", f"with {FILES} select sha256(content) as digest, max(path) as path, count(*) as uses from files group by 1")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = files(spark, sf_dir).select("path", F.sha2("content", 256).alias("digest"), F.lit(0).alias("place"))
    return C.index(x).select("digest", "path", "uses")


@query("fn22_content_hash", f"with {FILES} select doc_id, substr(sha256(content), 1, 32) as hash from files")
def fn22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", F.substring(F.sha2("content", 256), 1, 32).alias("hash"))


_SETS = f"{FILES}, a as (select sha256(content) as digest from files where doc_id % 3 <> 0), b as (select sha256(content) as digest from files where doc_id % 3 <> 1)"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("digest"))
    return x.where("doc_id % 3 <> 0").select("digest"), x.where("doc_id % 3 <> 1").select("digest")


@query("set1_reachable_union", f"with {_SETS} select digest from a union select digest from b")
def set1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.union(b).distinct()


@query("set2_distinct_chunks", f"with {_SETS} select digest, count(*) as n from a group by digest")
def set2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir)[0].groupBy("digest").agg(F.count(F.lit(1)).alias("n"))


@query("set3_reclaimable_difference", f"with {_SETS} select digest from a except select digest from b")
def set3(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.subtract(b)


@query("jn9_reclaim_anti_join", f"with {_SETS} select distinct digest from a where digest not in (select digest from b)")
def jn9(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.distinct().join(b, "digest", "left_anti")


@query("set4_channel_complement", "select vec_id, list_filter(range(0, 64), lambda i: not list_contains([vec_id % 64, (vec_id * 7 + 3) % 64, (vec_id * 11 + 5) % 64], i))::int[] as free from embeddings".replace("::int[]", ""))
def set4(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), F.array(v % 64, (v * 7 + 3) % 64, (v * 11 + 5) % 64)).alias("free"))


@query(
    "df12_inode_tiers",
    """with c as (select l_orderkey as file, unnest(range(0, (l_quantity * 8000)::bigint, 997)) as place from lineitem),
    t as (select file, place, case when place < 12 then 'direct' when place - 12 < 256 then 'single' when place - 12 < 256 + 65536 then 'double' else 'triple' end as tier,
      case when place - 12 < 256 then 0 when place - 12 < 65792 then (place - 12 - 256) // 256 else (place - 12 - 65792) // 256 end as block from c)
    select file, tier, count(*) as chunks, max(block)::bigint as last_block from t group by file, tier""",
)
def df12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 997th place of each line's length; a tier's places are counted, not made."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.expr("cast(l_quantity * 8000 as bigint)").alias("length"))
    ends = [0, C.DIRECT, C.DIRECT + C.PER_BLOCK, C.DIRECT + C.PER_BLOCK + C.PER_BLOCK**2, None]
    before = lambda end: F.ceil((F.col("length") if end is None else F.least(F.col("length"), F.lit(end))) / 997)
    spans = F.array(*(F.struct(before(a).alias("a"), before(b).alias("b")) for a, b in zip(ends, ends[1:])))
    x = line.select("file", F.explode(spans).alias("s")).select("file", (F.col("s.b") - F.col("s.a")).alias("chunks"), ((F.col("s.b") - 1) * 997).alias("place")).where("chunks > 0")
    return x.select("file", "chunks", *C.inode_tier()).groupBy("file", "tier").agg(F.sum("chunks").alias("chunks"), F.max("block").alias("last_block"))


@query("df13_flatten_tiers", "select l_orderkey as file, count(*) as chunks, string_agg(l_partkey::varchar, ',' order by (l_linenumber - 1) * 11003 + l_orderkey % 300, l_partkey::varchar) as content from lineitem group by 1")
def df13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at places of every tier, and a file read back by its tiers, their blocks and the entries of these."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").cast("string").alias("chunk"), ((F.col("l_linenumber") - 1) * 11003 + F.col("l_orderkey") % 300).alias("place"))
    tiers = F.array(*map(F.lit, ("direct", "single", "double", "triple")))
    entry = F.when(F.col("tier") == "direct", F.col("place")).otherwise((F.col("place") - C.DIRECT) % C.PER_BLOCK)
    held = c.select("file", "chunk", "place", *C.inode_tier()).select("file", F.struct(F.array_position(tiers, F.col("tier")).alias("tier"), "block", entry.alias("entry"), "chunk").alias("c"))
    return held.groupBy("file").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.sort_array(F.collect_list("c")).getField("chunk"), ",").alias("content"))


@query("top10_read_truncation", f"with {FILES} select doc_id, strlen(content) > 16384 as truncated, least(length(content), 4096)::int as shown from files")
def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", (F.octet_length("content") > 16_384).alias("truncated"), F.length(F.substring("content", 1, 4096)).alias("shown"))


@query("fu6_read_slice", f"with {FILES} select doc_id, sha256(substr(content, 101, 50)) as digest, length(substr(content, 101, 50))::int as n from files")
def fu6(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = F.substring("content", 101, 50)
    return files(spark, sf_dir).select("doc_id", F.sha2(piece, 256).alias("digest"), F.length(piece).alias("n"))


@query("agg22_file_crc32")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.crc32(F.col("content")).alias("crc"), F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0").alias("crc_hex"))


@query("snk2_pointer_codec", "select l_orderkey, l_linenumber, (l_suppkey % 65536)::int as slot, l_orderkey * 8 as start, l_linenumber * 4096 as bits from lineitem")
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers packed to sixteen little-endian bytes and unpacked again."""
    from ..functions.records import packed_pointer, unpacked_pointer

    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 65_536).cast("int").alias("slot"), (F.col("l_orderkey") * 8).alias("start"), (F.col("l_linenumber") * 4096).alias("bits"))
    p = x.select("l_orderkey", "l_linenumber", packed_pointer(F.col("slot"), F.col("start"), F.col("bits"), F.lit(0)).alias("p"))
    return p.select("l_orderkey", "l_linenumber", unpacked_pointer(F.col("p")).alias("u")).select("l_orderkey", "l_linenumber", "u.slot", "u.start", "u.bits")
