"""Queries on the path namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import FILES, files
from ..functions import paths as P
from ..operators import trees as T
from ..registry import query, table

_DIRS = """dirs as (select distinct path from (
  select '/' || lang as path from documents where lang is not null union all select '/' || lang || '/' || source from documents where lang is not null and source is not null))"""
_ENTRIES = f"""{FILES}, {_DIRS}, entries as (
  select path, 'file' as kind, strlen(content)::bigint as length, sha256(content) as digest from files
  union all select path, 'dir', 0, null from dirs),
adj as (select case when path like '/%/%' then regexp_extract(path, '^(.*)/[^/]+$', 1) else '/' end as parent, regexp_extract(path, '([^/]+)$', 1) as name, kind, length from entries)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_files(files(spark, sf_dir))


@query("jn10_directory_entries", f"with {_ENTRIES} select parent, name, kind, length from adj")
def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.adjacency(_entries(spark, sf_dir))


@query("top8_directory_order", f"with {_ENTRIES} select (row_number() over (order by name) - 1)::int as place, name, kind from adj where parent = '/en'")
def top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    x = T.adjacency(_entries(spark, sf_dir)).where("parent = '/en'")
    return x.select((F.row_number().over(W.orderBy("name")) - 1).alias("place"), "name", "kind")


@query("cli5_ls", f"with {_ENTRIES} select case when kind = 'dir' then name || '/' else length || chr(9) || name end as line from adj where parent = '/en/src1'")
def cli5(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.listing(_entries(spark, sf_dir), "/en/src1")
    return x.select(F.when(F.col("kind") == "dir", F.concat("name", F.lit("/"))).otherwise(F.concat_ws("\t", F.col("length").cast("string"), "name")).alias("line"))


@query("df17_recursive_walk", f"with {_ENTRIES} select path, kind, length, (length(path) - length(replace(path, '/', '')))::int as depth from entries")
def df17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.walked(_entries(spark, sf_dir)).select("path", "kind", "length", "depth")


@query(
    "df16_tree_walk_recursive",
    f"""with recursive {_ENTRIES}, walk as (
      select '/' || name as path, kind, 1 as depth from adj where parent = '/'
      union all select w.path || '/' || a.name, a.kind, w.depth + 1 from walk w join adj a on a.parent = w.path where w.kind = 'dir')
    select path, kind, depth from walk""",
)
def df16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk from the root as a recursive query: one join for each level."""
    adj = T.adjacency(_entries(spark, sf_dir))
    return spark.sql(
        """with recursive walk(path, kind, depth) as (
             select concat('/', name), kind, 1 from {adj} where parent = '/'
             union all select concat(w.path, '/', a.name), a.kind, w.depth + 1 from walk w join {adj} a on a.parent = w.path where w.kind = 'dir')
           select path, kind, depth from walk""",
        adj=adj,
    )


@query(
    "fn25_parse_path",
    """with p as (select page_id, case when page_id % 5 = 0 then substr(url, 8) when page_id % 7 = 0 then '/a/../b' when page_id % 11 = 0 then '//x///y/' else '/' || regexp_replace(url, '^[a-z]+://', '') end as path from pages),
    s as (select page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from p)
    select page_id, path, len(parts)::int as n_parts, case when not starts_with(path, '/') then 'relative' when list_contains(parts, '.') or list_contains(parts, '..') then 'dots'
      when len(list_filter(parts, lambda x: strlen(x) > 255)) > 0 then 'too_long' end as invalid, '/' || array_to_string(parts, '/') as norm from s""",
)
def fn25(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.expr("substr(url, 8)")).when(F.col("page_id") % 7 == 0, "/a/../b").when(F.col("page_id") % 11 == 0, "//x///y/").otherwise(F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""))).alias("path"))
    c = F.col("path")
    return p.select("page_id", "path", F.size(P.parts(c)).alias("n_parts"), P.invalid(c).alias("invalid"), P.joined(P.parts(c)).alias("norm"))


@query(
    "fn26_split_parent_leaf",
    f"with {FILES} select doc_id, regexp_extract(path, '^(.*)/[^/]+$', 1) as parent, regexp_extract(path, '([^/]+)$', 1) as leaf from files",
)
def fn26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", P.parent(F.col("path")).alias("parent"), P.leaf(F.col("path")).alias("leaf"))


@query("fn27_parent_prefixes", f"with {_DIRS}, d as (select doc_id, lang, source from documents) select doc_id, '/' || lang as prefix, 0 as place from d union all select doc_id, '/' || lang || '/' || source, 1 from d")
def fn27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", F.posexplode(P.prefixes(F.col("path"))).alias("place", "prefix"))


@query("prj14_name_validity", "select page_id, strlen(html) between 1 and 255 and not contains(html, '/') as whole_ok, strlen(url) between 1 and 255 and not contains(url, '/') as url_ok from pages")
def prj14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.valid_name(F.col("html")).alias("whole_ok"), P.valid_name(F.col("url")).alias("url_ok"))


def _new_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("/en/new"), F.col("n_nationkey").cast("string"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("/nowhere/x"), F.col("n_nationkey").cast("string"))).otherwise(F.lit("/en/src1")).alias("path"))


_NEW = "wanted as (select distinct case when n_nationkey % 3 = 0 then '/en/new' || n_nationkey when n_nationkey % 3 = 1 then '/nowhere/x' || n_nationkey else '/en/src1' end as path from nation)"


@query(
    "dml1_mkdir",
    f"""with {_ENTRIES}, {_NEW} select w.path, case when e.path is not null then 'exists' when u.path is null then 'no_parent' when u.kind = 'file' then 'not_a_directory' else 'made' end as outcome
    from wanted w left join entries e on e.path = w.path left join entries u on u.path = regexp_extract(w.path, '^(.*)/[^/]+$', 1)""",
)
def dml1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.made_directories(_entries(spark, sf_dir), _new_dirs(spark, sf_dir))[1]


@query(
    "dml2_rmdir",
    f"""with {_ENTRIES}, {_NEW}, kids as (select distinct parent from adj) select w.path, case when e.path is null then 'missing' when e.kind = 'file' then 'not_a_directory' when k.parent is not null then 'not_empty' else 'removed' end as outcome
    from wanted w left join entries e on e.path = w.path left join kids k on k.parent = w.path""",
)
def dml2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.removed_directories(_entries(spark, sf_dir), _new_dirs(spark, sf_dir))[1]


@query("dml4_unlink", f"with {_ENTRIES} select kind, count(*) as n, sum(length)::bigint as bytes from entries where not (kind = 'file' and regexp_extract(path, '/([0-9]+)\\.txt$', 1)::int % 4 = 0) group by kind".replace("regexp_extract(path, '/([0-9]+)\\.txt$', 1)::int", "try_cast(regexp_extract(path, '/([0-9]+)\\.txt$', 1) as int)").replace("where not (", "where not coalesce(").replace(" = 0) group", " = 0, false) group"))
def dml4(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = files(spark, sf_dir).where("doc_id % 4 = 0").select("path")
    return T.unlinked(_entries(spark, sf_dir), gone)[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query(
    "dml3_create_or_overwrite",
    f"""with {_ENTRIES}, n as (select case when doc_id % 2 = 0 then path else path || '.new' end as path, 'v2 ' || content as content from files where doc_id % 3 = 0),
    nn as (select path, strlen(content)::bigint as length from n), after as (select path, kind, length from entries where path not in (select path from nn) union all select path, 'file', length from nn)
    select kind, count(*) as n, sum(length)::bigint as bytes from after group by kind""",
)
def dml3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("doc_id % 3 = 0")
    new = f.select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit(".new"))).alias("path"), F.concat(F.lit("v2 "), "content").alias("content"))
    return T.put_files(_entries(spark, sf_dir), new).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("dml5_lookup", f"with {_ENTRIES}, {_NEW} select w.path, e.kind, e.length from wanted w left join entries e on e.path = w.path")
def dml5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.resolved(_new_dirs(spark, sf_dir).distinct(), _entries(spark, sf_dir))


@query("set5_duplicate_names", f"with {FILES} select content, count(*) as n, min(path) as first_path from files group by content having count(*) > 1".replace("select content,", "select sha256(content) as digest,"))
def set5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(F.sha2("content", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


@query("jn14_inode_numbers", f"with {_DIRS} select path, (dense_rank() over (order by path) + 1)::int as inode from dirs")
def jn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable numbers for directories, the root being 1."""
    d = T.from_files(files(spark, sf_dir)).where("kind = 'dir'").select("path")
    return T.numbered(d, "path").select("path", (F.col("number") + 1).cast("int").alias("inode"))


@query("fu5_readdir_page", f"with {_ENTRIES} select name, kind from adj where parent = '/en' order by name limit 5 offset 3")
def fu5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a directory: five names after the first three (paging is the feature)."""
    return T.listing(_entries(spark, sf_dir), "/en").orderBy("name").offset(3).limit(5).select("name", "kind")
