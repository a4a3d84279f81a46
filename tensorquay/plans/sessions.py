"""Queries on write logs, status and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import FILES, WRITE_LOG, files, tensors, write_log
from ..functions.bits import type_name
from ..operators import buffers as B
from ..operators import slots as S
from ..operators import trees as T
from ..registry import query, table
from .slots import _SLOTS
from .trees import _ENTRIES


@query("st2_write_buffer_sizes", f'with {WRITE_LOG} select file, max("offset" + length) as size, count(*) as revision from write_log group by file')
def st2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sizes(write_log(spark, sf_dir))


@query("st2_write_buffer_fold")
def st2_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.folded(write_log(spark, sf_dir))


@query("st2_last_writer", f'with {WRITE_LOG} select file, b as block, max(seq) as seq from (select file, seq, unnest(range("offset" // 16, ("offset" + length - 1) // 16 + 1)) as b from write_log) group by file, b')
def st2_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_writer(write_log(spark, sf_dir))


@query(
    "st3_flush_revisions",
    f"""with {WRITE_LOG}, r as (select file, seq, event_type, row_number() over (partition by file order by seq) as revision from write_log)
    select file, max(revision) as revision, coalesce(max(revision) filter (where event_type = 'purchase'), 0) as flushed, max(revision) > coalesce(max(revision) filter (where event_type = 'purchase'), 0) as dirty from r group by file""",
)
def st3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last revision each file flushed, and whether it has changed since."""
    r = write_log(spark, sf_dir).select("file", "event_type", F.row_number().over(W.partitionBy("file").orderBy("seq")).cast("long").alias("revision"))
    x = r.groupBy("file").agg(F.max("revision").alias("revision"), F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("revision"))), F.lit(0).cast("long")).alias("flushed"))
    return x.withColumn("dirty", F.col("revision") > F.col("flushed"))


@query("st4_truncate", f"""with {WRITE_LOG}, s as (select file, max("offset" + length) as size from write_log group by file) select file, size, least(size, 500) as truncated, greatest(500 - size, 0) as zeros from s""")
def st4(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.sizes(write_log(spark, sf_dir))
    limit = F.lit(500).cast("long")
    return s.select("file", "size", F.least("size", limit).alias("truncated"), F.greatest(limit - F.col("size"), F.lit(0).cast("long")).alias("zeros"))


@query("st5_read_your_writes", f"""with {WRITE_LOG}, s as (select file, max("offset" + length) as size from write_log group by file), k as (select c_custkey as file, 100 as stored from customer)
    select k.file, coalesce(s.size, k.stored)::bigint as size, s.file is not null as buffered from k left join s on s.file = k.file""")
def st5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer's size, if there is one, shadows the stored size."""
    s = B.sizes(write_log(spark, sf_dir)).select(F.col("file").alias("b_file"), "size")
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"))
    return k.join(s, F.col("file") == F.col("b_file"), "left").select("file", F.coalesce("size", F.lit(100).cast("long")).alias("size"), F.col("b_file").isNotNull().alias("buffered"))




@query(
    "agg8_status_report",
    f"""{_SLOTS}, {_ENTRIES} select (select count(*) from entries where kind = 'file') as files, (select count(*) from entries where kind = 'dir') as dirs,
      (select sum(length) from entries)::bigint as bytes, (select sum(bit_end - bit_start) // 8 from slots)::bigint as capacity, (select count(distinct digest) from entries) as contents,
      (select string_agg(t, ',' order by s) from (select case raw_type when 0 then 'F32' when 1 then 'F16' when 8 then 'Q8_0' when 11 then 'Q3_K' when 12 then 'Q4_K' when 13 then 'Q5_K' when 14 then 'Q6_K' end as t, min(slot) as s from slots group by 1)) as types""",
)
def agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: counts of the namespace, capacity of the slots, types in order of first use."""
    e = T.from_files(files(spark, sf_dir)).agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.sum("length").alias("bytes"), F.countDistinct("digest").alias("contents"))
    s = S.slot_map(S.planned(tensors(spark, sf_dir))).withColumn("type", type_name(F.col("raw_type")))
    first = s.groupBy("type").agg(F.min("slot").alias("slot"), F.sum(F.col("bit_end") - F.col("bit_start")).alias("bits"))
    r = first.agg(F.expr("sum(bits) div 8").alias("capacity"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "type"))), lambda x: x["type"]), ",").alias("types"))
    return e.crossJoin(r).select("files", "dirs", "bytes", "capacity", "contents", "types")  # one row each


@query("snk13_human_status", f"with {_ENTRIES} select kind || 's: ' || count(*) || ' (' || printf('%.3f', 100.0 * count(*) / (select count(*) from entries)) || '%)' as line from entries group by kind")
def snk13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.from_files(files(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(W.partitionBy())
    return e.select(F.format_string("%ss: %d (%.3f%%)", "kind", "n", share).alias("line"))


_CALLS = """calls as (select conv_id, turn, case conv_id % 5 when 0 then 'ls' when 1 then 'read' when 2 then 'stat' when 3 then 'list_all_files' else 'format_disk' end as tool,
  case when turn % 3 = 2 then 'not json' else '{"path":"/en/src' || (conv_id % 20) || '"}' end as arguments from conversations where role = 'user')"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    tool = F.when(F.col("conv_id") % 5 == 0, "ls").when(F.col("conv_id") % 5 == 1, "read").when(F.col("conv_id") % 5 == 2, "stat").when(F.col("conv_id") % 5 == 3, "list_all_files").otherwise("format_disk")
    args = F.when(F.col("turn") % 3 == 2, "not json").otherwise(F.concat(F.lit('{"path":"/en/src'), (F.col("conv_id") % 20).cast("string"), F.lit('"}')))
    return c.select("conv_id", "turn", tool.alias("tool"), args.alias("arguments"))


@query("fn32_tool_arguments", f"with {_CALLS} select conv_id, turn, tool, case when json_valid(arguments) then arguments->>'path' end as path, not json_valid(arguments) as empty from calls")
def fn32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool call's path; arguments that are not JSON count as an empty object."""
    parsed = F.from_json("arguments", "path string")
    return _calls(spark, sf_dir).select("conv_id", "turn", "tool", parsed["path"].alias("path"), parsed["path"].isNull().alias("empty"))


@query(
    "st6_tool_rounds",
    f"""with {_ENTRIES}, {_CALLS}, n as (select *, row_number() over (partition by conv_id order by turn) as round, case when json_valid(arguments) then arguments->>'path' else '' end as asked from calls),
    k as (select parent, count(*) as children from adj group by parent)
    select conv_id, turn, round, tool, case when round > 8 then 'too many rounds' when tool = 'format_disk' then 'unknown tool' when tool = 'list_all_files' then (select count(*) from entries where kind = 'file')::varchar
      when asked = '' then 'missing path' when e.path is null then 'not found' when tool = 'ls' then coalesce(children, 0)::varchar when tool = 'stat' then e.kind else 'is a directory' end as result
    from n left join entries e on e.path = n.asked left join k on k.parent = n.asked""",
)
def st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's calls in order, at most eight answered, over one snapshot."""
    e = T.from_files(files(spark, sf_dir))
    kids = T.adjacency(e).groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
    total = e.agg(F.count_if(F.col("kind") == "file").alias("all_files"))
    c = _calls(spark, sf_dir).withColumn("round", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")).withColumn("asked", F.coalesce(F.from_json("arguments", "path string")["path"], F.lit("")))
    x = c.join(e.select("path", "kind"), F.col("asked") == F.col("path"), "left").join(kids, F.col("asked") == F.col("parent"), "left").crossJoin(F.broadcast(total))
    result = (
        F.when(F.col("round") > 8, "too many rounds")
        .when(F.col("tool") == "format_disk", "unknown tool")
        .when(F.col("tool") == "list_all_files", F.col("all_files").cast("string"))
        .when(F.col("asked") == "", "missing path")
        .when(F.col("path").isNull(), "not found")
        .when(F.col("tool") == "ls", F.coalesce("children", F.lit(0)).cast("string"))
        .when(F.col("tool") == "stat", F.col("kind"))
        .otherwise("is a directory")
    )
    return x.select("conv_id", "turn", "round", "tool", result.alias("result"))


@query("ask1_ls_json", f"""with {_ENTRIES} select '[' || string_agg('{{"name":"' || name || '","kind":"' || kind || '","size_bytes":' || length || '}}', ',' order by name) || ']' as payload from adj where parent = '/de'""")
def ask1(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.adjacency(T.from_files(files(spark, sf_dir))).where("parent = '/de'")
    return x.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "kind", F.col("length").alias("size_bytes"))))).alias("payload"))


@query("ask2_read_json", f"""with {FILES} select path, strlen(content) > 16384 as truncated, strlen(content)::bigint as size_bytes from files""")
def ask2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    payload = F.to_json(F.struct("path", (F.octet_length("content") > 16_384).alias("truncated"), F.octet_length("content").cast("long").alias("size_bytes")))
    return f.select(F.from_json(payload, "path string, truncated boolean, size_bytes long").alias("p")).select("p.*")


@query("ask3_stat_crc")
def ask3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select(F.to_json(F.struct("path", F.lit("file").alias("kind"), F.octet_length("content").alias("size_bytes"), F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0").alias("crc32"))).alias("payload"))


@query("ask4_list_all_files", f"with {_ENTRIES} select path, length as size_bytes from entries where kind = 'file'")
def ask4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_files(files(spark, sf_dir)).where("kind = 'file'").select("path", F.col("length").alias("size_bytes"))


#: Error class -> number that a mount reports (fixed values).
ERRNO = {"missing": 2, "exists": 17, "not_a_directory": 20, "is_a_directory": 21, "invalid": 22, "no_space": 28, "too_long": 36, "not_empty": 39, "io": 5}


@query("fn35_error_numbers", f"with e as (select o_orderkey, [{', '.join(repr(k) for k in ERRNO)}][o_orderkey % {len(ERRNO)} + 1] as error from orders) select error, count(*) as n, (case error {' '.join(f'''when '{k}' then {v}''' for k, v in ERRNO.items())} end)::int as number from e group by error")
def fn35(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ERRNO))
    table_ = F.create_map(*(F.lit(x) for kv in ERRNO.items() for x in kv))
    e = table(spark, sf_dir, "orders").select(F.get(names, (F.col("o_orderkey") % len(ERRNO)).cast("int")).alias("error"))
    return e.groupBy("error").agg(F.count(F.lit(1)).alias("n")).select("error", "n", table_[F.col("error")].alias("number"))
