"""A hierarchical namespace as a table of paths (path, kind, length, digest), one snapshot each.

Verbs take a snapshot and give the next one; a verb that is not allowed leaves it as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import stored

ENTRY = ("path", "kind", "length", "digest")


def from_files(files: DataFrame) -> DataFrame:
    """Entries for files (path, content) and all directories above them."""
    f = files.select("path", F.lit("file").alias("kind"), F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("digest"))
    d = files.select(F.explode(P.prefixes(F.col("path"))).alias("path")).distinct()
    return f.unionByName(d.select("path", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("digest")))


def adjacency(entries: DataFrame) -> DataFrame:
    """(parent, name, kind, length): one row for each directory entry."""
    return entries.select(P.parent(F.col("path")).alias("parent"), P.leaf(F.col("path")).alias("name"), "kind", "length")


def listing(entries: DataFrame, directory: str) -> DataFrame:
    return adjacency(entries).where(F.col("parent") == directory).select("name", "kind", "length").orderBy("name")


def walked(entries: DataFrame) -> DataFrame:
    """All entries depth first with names in byte order: the order of their paths' parts."""
    return entries.withColumn("depth", F.size(P.parts(F.col("path")))).orderBy(P.parts(F.col("path")))


def resolved(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Each wanted path (column path) with its kind and length; null kind if it isn't there."""
    e = entries.select(F.col("path").alias("e_path"), "kind", "length")
    return wanted.withColumn("norm", P.joined(P.parts(F.col("path")))).join(e, F.col("norm") == F.col("e_path"), "left").drop("norm", "e_path")


def made_directories(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mkdir for many paths: (the next snapshot, the outcome of each path)."""
    e = entries.select(F.col("path").alias("e_path"), F.col("kind").alias("e_kind"))
    up = entries.select(F.col("path").alias("u_path"), F.col("kind").alias("u_kind"))
    x = new.select("path").distinct().join(e, F.col("path") == F.col("e_path"), "left").withColumn("up", P.parent(F.col("path"))).join(up, F.col("up") == F.col("u_path"), "left")
    said = F.when(P.invalid(F.col("path")).isNotNull(), P.invalid(F.col("path"))).when(F.col("e_path").isNotNull(), "exists").when((F.col("up") != "/") & F.col("u_kind").isNull(), "no_parent").when(F.col("u_kind") == "file", "not_a_directory").otherwise("made")
    x = x.select("path", said.alias("outcome"))
    rows = x.where("outcome = 'made'").select("path", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("digest"))
    return entries.select(*ENTRY).unionByName(rows), x


def removed_directories(entries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rmdir for many paths: only empty directories go."""
    child = adjacency(entries).select(F.col("parent").alias("c_parent")).distinct()
    e = entries.select(F.col("path").alias("e_path"), F.col("kind").alias("e_kind"))
    x = gone.select("path").distinct().join(e, F.col("path") == F.col("e_path"), "left").join(child, F.col("path") == F.col("c_parent"), "left")
    x = x.select("path", F.when(F.col("e_path").isNull(), "missing").when(F.col("e_kind") == "file", "not_a_directory").when(F.col("c_parent").isNotNull(), "not_empty").otherwise("removed").alias("outcome"))
    return entries.join(x.where("outcome = 'removed'"), "path", "left_anti"), x


def unlinked(entries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unlink for many paths: only files go."""
    e = entries.select(F.col("path").alias("e_path"), F.col("kind").alias("e_kind"))
    x = gone.select("path").distinct().join(e, F.col("path") == F.col("e_path"), "left")
    x = x.select("path", F.when(F.col("e_path").isNull(), "missing").when(F.col("e_kind") == "dir", "is_a_directory").otherwise("removed").alias("outcome"))
    return entries.join(x.where("outcome = 'removed'"), "path", "left_anti"), x


def put_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Create or overwrite files (path, content); a path that is a directory is left alone."""
    new = from_files(files).where("kind = 'file'")
    dirs = entries.where("kind = 'dir'").select("path")
    allowed = new.join(dirs, "path", "left_anti")
    return entries.select(*ENTRY).join(allowed.select("path"), "path", "left_anti").unionByName(allowed.select(*ENTRY))


def reachable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Chunks (digest) of the former snapshot that the next one no longer holds."""
    return before.where("digest is not null").select("digest").subtract(after.where("digest is not null").select("digest"))


def numbered(rows: DataFrame, by: str, name: str = "number") -> DataFrame:
    """``rows`` with their dense rank by a column, from 1: ranks within ranges that are dealt once, then
    the sum of the ranges before (one row for each range)."""
    dealt = stored(rows.repartitionByRange(by).withColumn("range", F.spark_partition_id()), "numbered")
    ranked = dealt.withColumn(name, F.dense_rank().over(W.partitionBy("range").orderBy(by)).cast("long"))
    earlier = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = ranked.groupBy("range").agg(F.max(name).alias("size")).select("range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    return ranked.join(F.broadcast(before), "range").withColumn(name, F.col(name) + F.col("before")).drop("range", "before")
