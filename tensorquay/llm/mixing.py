"""Mixing sources to target weights (operator 2).

Every document has a hash; each source takes whole rounds of all its documents, and of the last
round those whose hash lies below a threshold.  Thresholds come from histograms: words are summed by
source and leading bits of the hash, running sums find the bucket in which the budget ends, and only
that bucket is looked at again with the next bits, until it holds one hash.  The mix is then a filter;
nothing is sorted, and a larger budget takes all that a smaller one takes.

Defined cases: a null or empty text has size 0; null is a source of its own, last in order; sources
without words have target 0 and take nothing; rows with the same doc_id and text have one hash and are
taken together; rows with null doc_id are told apart by their text; an empty table gives an empty
table; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Bits of the hash, and how many of them each histogram resolves.
HASH_BITS, STEP_BITS = 60, 12
WEIGHTS = (5, 2, 1)


def words(text: str = "text") -> Column:
    """Number of words, runs of other characters than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of a digest of the row's identity."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt by weight, none above ``most`` sizes.

    Dealing the excess anew until none is above ends where each source has the lesser of its ceiling
    and a common level times its weight; running sums over the sources, by ceiling per weight, find
    that level.  One row stands for each source, in one task that spills if they are very many.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    s = sizes.select("*", weight.alias("w"), (F.col("source_size") * most).alias("ceiling"))
    by_ratio = W.orderBy(F.col("ceiling") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("ceiling").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    s = s.select("*", ((share * F.sum("source_size").over(W.partitionBy()) - before) / rest).alias("level"))
    fits = F.col("level") * F.col("w") <= F.col("ceiling")
    level = F.min(F.when(fits, F.struct(F.col("ceiling") / F.col("w"), "level"))).over(W.partitionBy()).getField("level")
    return s.select("source", "source_size", F.least(F.col("ceiling"), level * F.col("w")).alias("target"))


def _boundary(hist: DataFrame) -> DataFrame:
    """Of each source's histogram (source, code, size, room): the bucket in which the room ends, and
    the room left for it; no row if all buckets fit."""
    run = F.sum("size").over(W.partitionBy("source").orderBy("code").rowsBetween(W.unboundedPreceding, 0))
    x = hist.select("source", "code", "room", "size", run.alias("up")).where("up > room")
    first = x.groupBy("source").agg(F.min(F.struct("code", "up", "size", "room")).alias("x"))
    return first.select("source", F.col("x.code").alias("edge"), (F.col("x.room") - (F.col("x.up") - F.col("x.size"))).alias("room"), F.col("x.size").alias("edge_size"))


def thresholds(sized: DataFrame, rooms: DataFrame) -> DataFrame:
    """(source, bar): documents with hash < bar take part; their words come nearest to the room.

    ``sized`` has source, size, h; ``rooms`` has source, room (words that the last round may take).
    """
    on = lambda a, b: a["source"].eqNullSafe(b["source"])
    shift = HASH_BITS
    state = rooms.select("source", "room", F.lit(0).cast("long").alias("edge"))
    while shift:
        shift -= STEP_BITS
        s = state.withColumnRenamed("source", "s_source")
        inside = sized.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.shiftright("h", shift + STEP_BITS) == F.col("edge")))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("code"), "room").agg(F.sum("size").alias("size"))
        state = written(_boundary(hist), "mix-edge")
    # the last bucket is one hash: it is taken if that ends nearer to the room
    bar = F.when(2 * F.col("room") >= F.col("edge_size"), F.col("edge") + 1).otherwise(F.col("edge"))
    end = state.select(F.col("source").alias("e_source"), bar.alias("bar"))
    return rooms.join(end, F.col("source").eqNullSafe(F.col("e_source")), "left").select("source", F.coalesce("bar", F.lit(1 << HASH_BITS).cast("long")).alias("bar"))


def plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(documents' doc_id, source, size, h; sources' source, source_size, target, rounds, bar)."""
    sized = written(docs.select("doc_id", "source", words().alias("size"), mix_hash().alias("h")), "mix-sizes")
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = written(targets(by, share, most, weights), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("rounds", whole)
    bars = thresholds(sized, t.select("source", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("room")))
    b = bars.withColumnRenamed("source", "b_source")
    full = t.join(b, F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source")
    none = (F.col("target") <= F.col("rounds") * F.col("source_size")) | (F.col("source_size") == 0)
    return sized, written(full.withColumn("bar", F.when(none, F.lit(0).cast("long")).otherwise(F.col("bar"))), "mix-plan")


def copies() -> Column:
    return F.col("rounds") + F.when(F.col("h") < F.col("bar"), 1).otherwise(0)


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, with the same columns."""
    names = docs.columns
    _, sources = plan(docs, share, most)
    s = sources.withColumnRenamed("source", "s_source")
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col("source"), mix_hash().alias("h"))
    taken = inner.join(s, F.col("source").eqNullSafe(F.col("s_source")), "left").withColumn("times", copies()).where("times > 0")
    again = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return again.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, sources = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    s = sources.withColumnRenamed("source", "s_source")
    x = sized.join(s, F.col("source").eqNullSafe(F.col("s_source")), "left")
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"), "source")


ORACLE_MIX_SOURCES = r"""
with d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || chr(31) || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, 2.0::double * source_size as ceiling,
         [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source is null, source) - 1) % 3)::int + 1] as w
  from s),
l as (
  select *, (1.5::double * sum(source_size) over ()
             - coalesce(sum(ceiling) over (order by ceiling / w, source is null, source rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by ceiling / w, source is null, source rows between current row and unbounded following) as level
  from w),
t as (
  select source, source_size, w,
         least(ceiling, (first_value(level) over (order by case when level * w <= ceiling then 0 else 1 end, ceiling / w, level)) * w) as target
  from l),
r as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as rounds from t),
p as (
  select d.*, r.source_size, r.target, r.rounds, r.target - r.rounds * r.source_size as room from d join r on d.source is not distinct from r.source),
g as (
  select source, h, sum(size) as size, any_value(room) as room from p group by source, h),
u as (
  select *, sum(size) over (partition by source order by h) as up from g),
e as (
  select source, min(h) as edge from u where up > room group by source),
b as (
  select e.source, case when 2 * (u.room - (u.up - u.size)) >= u.size then edge + 1 else edge end as bar
  from e join u on u.source is not distinct from e.source and u.h = e.edge)
select p.doc_id, p.size, p.source_size, p.target,
       (p.size * (p.rounds + case when p.room > 0 and p.source_size > 0 and (b.bar is null or p.h < b.bar) then 1 else 0 end))::bigint as taken,
       p.source
from p left join b on p.source is not distinct from b.source
"""
