"""Queries on free runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import RUNS, runs
from ..operators import intervals as I
from ..registry import query, table


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 7).cast("int").alias("slot"), (F.col("p_partkey") * 113).alias("at"))


_POINTS = "points as (select (p_partkey % 7)::int as slot, p_partkey * 113 as at from part)"


@query("jn4_run_containing", f"with {RUNS}, {_POINTS} select p.slot, p.at, r.start as r_start, r.length as r_length from points p left join runs r on r.slot = p.slot and p.at >= r.start and p.at < r.start + r.length")
def jn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.containing(_points(spark, sf_dir), runs(spark, sf_dir))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 7).cast("int").alias("slot"), (F.col("p_partkey") * 113).alias("start"), (F.col("p_size").cast("long") + 1).alias("length"))


_RANGES = "ranges as (select (p_partkey % 7)::int as slot, p_partkey * 113 as start, p_size::bigint + 1 as length from part)"


@query("jn5_overlap_semi_join", f"with {RUNS}, {_RANGES} select distinct x.slot, x.start, x.length from ranges x where exists (select 1 from runs r where r.slot = x.slot and x.start < r.start + r.length and r.start < x.start + x.length)")
def jn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlapping(_ranges(spark, sf_dir), runs(spark, sf_dir))


@query(
    "jn6_adjacent_runs",
    f"""with {RUNS} select slot, start, length, coalesce(lag(start + length) over w = start, false) as touches_left,
    coalesce(lead(start) over w = start + length, false) as touches_right from runs window w as (partition by slot order by start)""",
)
def jn6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.neighbours(runs(spark, sf_dir))


_MERGED = """m1 as (select *, case when start <= max(start + length) over (partition by slot order by start, length rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from {0}),
m2 as (select *, sum(new) over (partition by slot order by start, length rows between unbounded preceding and current row) as island from m1),
merged as (select slot, min(start) as start, (max(start + length) - min(start))::bigint as length, max(ceiling) as ceiling, max(salience) as salience from m2 group by slot, island)"""


@query("win6_coalesce_runs", f"with {RUNS}, {_MERGED.format('runs')} select slot, start, length, ceiling, salience from merged")
def win6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(runs(spark, sf_dir))


@query(
    "set6_reserve_weights",
    f"""with {RUNS}, {_RANGES}, ev as (
      select slot, start as pos, 1 as free, 0 as used from runs union all select slot, start + length, -1, 0 from runs
      union all select slot, start, 0, 1 from ranges union all select slot, start + length, 0, -1 from ranges),
    g as (select slot, pos, sum(free) as free, sum(used) as used from ev group by slot, pos),
    u as (select slot, pos, sum(free) over w as free, sum(used) over w as used, lead(pos) over (partition by slot order by pos) as fin from g window w as (partition by slot order by pos)),
    f as (select slot, pos as start, fin - pos as length, 0.0 as ceiling, 0.0 as salience from u where free > 0 and used <= 0 and fin > pos),
    {_MERGED.format('f')} select slot, start, length from merged""",
)
def set6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.subtracted(runs(spark, sf_dir), _ranges(spark, sf_dir))


@query("df11_reserve_total", f"""with {RUNS}, {_RANGES}, hit as (
      select r.slot, greatest(r.start, x.start) as a, least(r.start + r.length, x.start + x.length) as b from runs r join ranges x on x.slot = r.slot and x.start < r.start + r.length and r.start < x.start + x.length),
    lost as (select slot, sum(b - a) as lost from hit group by slot), have as (select slot, sum(length) as have from runs group by slot)
    select have.slot, (have - coalesce(lost, 0))::bigint as free_weights from have left join lost on lost.slot = have.slot""")
def df11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.subtracted(runs(spark, sf_dir), _ranges(spark, sf_dir)).groupBy("slot").agg(F.sum("length").alias("free_weights"))


@query("agg4_free_weights", f"with {RUNS} select slot, count(*) as runs, sum(length)::bigint as free_weights, max(length) as longest from runs group by slot")
def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("slot").agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("free_weights"), F.max("length").alias("longest"))


@query("top6_best_fit", f"with {RUNS} select ceiling, salience, length, slot, start from runs where length * 8 >= 400 order by ceiling, salience, length, slot, start limit 1")
def top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.best_fit(runs(spark, sf_dir), 400, 8)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("req"), (F.col("s_suppkey") * 37 % 1000 + 1).alias("bits"))


@query(
    "top6_best_fit_each",
    f"""with {RUNS}, q as (select s_suppkey as req, s_suppkey * 37 % 1000 + 1 as bits from supplier),
    n as (select req, ceil(bits / 8.0)::bigint as weights from q),
    f as (select n.req, n.weights, r.*, row_number() over (partition by n.req order by ceiling, salience, length, slot, start) as k from n left join runs r on r.length >= n.weights)
    select req, weights, ceiling, salience, length, slot, start from f where k = 1""",
)
def top6_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.best_fits(_requests(spark, sf_dir), runs(spark, sf_dir), 8).withColumn("weights", F.col("weights").cast("long"))


@query("df8_allocate_in_order")
def df8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of seven pools, each served in order from its own slot's runs."""
    req = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("pool"), F.col("s_suppkey").alias("req"), (F.col("s_suppkey") * 37 % 1000 + 1).alias("bits"))
    return I.allocate(req, runs(spark, sf_dir).withColumn("pool", F.col("slot").cast("long")), 8)


@query(
    "df10_free_and_merge",
    f"""with {RUNS}, base as (select * from runs where start % 48 <> 0), back as (select * from runs where start % 48 = 0), allr as (select * from base union all select * from back),
    {_MERGED.format('allr')} select slot, count(*) as runs, sum(length)::bigint as free_weights from merged group by slot""",
)
def df10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return I.freed(r.where("start % 48 <> 0"), r.where("start % 48 = 0")).groupBy("slot").agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("free_weights"))


@query("prj11_pointer_ranges", f"""with {RUNS} select slot, start, length, case when length <= 0 then 'empty' when start + length > 100000 then 'past_end' else 'valid' end as verdict from runs""")
def prj11(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("start") + F.col("length")
    return runs(spark, sf_dir).select("slot", "start", "length", F.when(F.col("length") <= 0, "empty").when(end > 100_000, "past_end").otherwise("valid").alias("verdict"))


@query(
    "prj13_touched_weights",
    f"""with {RUNS}, b as (select slot, start, start % 50 as first_byte, length % 9 as n_bytes from runs where length % 9 > 0)
    select slot, start, w::bigint as weight from b, unnest(range(start + first_byte * 8 // 3, start + ((first_byte + n_bytes) * 8 - 1) // 3 + 1)) as t(w)""",
)
def prj13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights (three bits each) that a byte range of a chunk touches."""
    b = runs(spark, sf_dir).select("slot", "start", (F.col("start") % 50).alias("first_byte"), (F.col("length") % 9).alias("n_bytes")).where("n_bytes > 0")
    return b.select("slot", "start", F.explode(F.sequence(F.expr("start + first_byte * 8 div 3"), F.expr("start + ((first_byte + n_bytes) * 8 - 1) div 3"))).alias("weight"))


@query(
    "fu14_space_report",
    f"""with {RUNS} select sum(length)::bigint as free_weights, (sum(length) // 4096)::bigint as free_blocks, (2 * (sum(length) // 4096))::bigint as total_blocks from runs""",
)
def fu14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).agg(F.sum("length").alias("free_weights"), F.expr("sum(length) div 4096").alias("free_blocks"), F.expr("2 * (sum(length) div 4096)").alias("total_blocks"))
