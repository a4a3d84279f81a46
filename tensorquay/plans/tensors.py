"""Queries on vectors and token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tensor as T
from ..registry import query, table

_D = "list_transform(embedding, lambda x: x::double)"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query("fn37_dot_product", f"with e as (select vec_id, {_D} as x from embeddings) select a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.x[i] * b.x[i])), 6) as dot from e a join e b on b.vec_id = a.vec_id + 1")
def fn37(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.join(b, "vec_id").select("vec_id", F.round(T.dot(F.col("embedding"), F.col("y")), 6).alias("dot"))


@query("fn38_rmsnorm", f"with e as (select vec_id, {_D} as x from embeddings), n as (select vec_id, x, 1 / sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64 + 1e-5) as s from e) select vec_id, round(x[1] * s, 6) as first, round(list_sum(list_transform(x, lambda v: abs(v) * s)), 5) as total from n")
def fn38(spark: SparkSession, sf_dir: str) -> DataFrame:
    ones = F.transform("embedding", lambda v: F.lit(1.0))
    x = _embeddings(spark, sf_dir).select("vec_id", T.rmsnorm(F.col("embedding"), ones).alias("y"))
    return x.select("vec_id", F.round(F.get("y", F.lit(0)), 6).alias("first"), F.round(T.total(F.transform("y", F.abs)), 5).alias("total"))


@query("fn39_rope", f"with e as (select vec_id, {_D} as x from embeddings) select vec_id, round(x[3] * cos(vec_id % 50 * pow(10000.0::double, -2.0 / 64)) - x[4] * sin(vec_id % 50 * pow(10000.0::double, -2.0 / 64)), 6) as third, round(x[3] * sin(vec_id % 50 * pow(10000.0::double, -2.0 / 64)) + x[4] * cos(vec_id % 50 * pow(10000.0::double, -2.0 / 64)), 6) as fourth from e")
def fn39(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _embeddings(spark, sf_dir).select("vec_id", T.rope(F.col("embedding"), F.col("vec_id") % 50).alias("y"))
    return x.select("vec_id", F.round(F.get("y", F.lit(2)), 6).alias("third"), F.round(F.get("y", F.lit(3)), 6).alias("fourth"))


@query("fn40_softmax", f"with e as (select vec_id, {_D} as x from embeddings), m as (select vec_id, x, list_max(x) as m from e), s as (select vec_id, list_transform(x, lambda v: exp(v - m)) as p from m) select vec_id, round(p[1] / list_sum(p), 8) as first, round(list_max(p) / list_sum(p), 8) as top from s")
def fn40(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _embeddings(spark, sf_dir).select("vec_id", T.softmax(F.col("embedding")).alias("p"))
    return x.select("vec_id", F.round(F.get("p", F.lit(0)), 8).alias("first"), F.round(F.array_max("p"), 8).alias("top"))


@query("fn41_swiglu", f"with e as (select vec_id, {_D} as x from embeddings) select vec_id, round(list_sum(list_transform(range(1, 33), lambda i: x[i] / (1 + exp(-x[i])) * x[i + 32])), 6) as total from e")
def fn41(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _embeddings(spark, sf_dir).select("vec_id", F.round(T.total(T.swiglu(F.slice(e, 1, 32), F.slice(e, 33, 32))), 6).alias("total"))


@query("fn42_log_softmax_at", f"with e as (select vec_id, {_D} as x from embeddings) select vec_id, round(x[vec_id % 64 + 1] - (list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))), 8) as logp from e")
def fn42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select("vec_id", F.round(T.log_softmax_at(F.col("embedding"), (F.col("vec_id") % 64).cast("int")), 8).alias("logp"))


@query(
    "fn36_matmul",
    """with w as (select vec_id as o, embedding as w from embeddings where vec_id < 16)
    select e.vec_id, w.o, round(list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * w.w[i]::double)), 6) as y from embeddings e, w""",
)
def fn36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x times the transpose of sixteen fixed rows: relational, on the inner dimension."""
    e = _embeddings(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("k", "v"))
    w = e.where("vec_id < 16").select(F.col("vec_id").alias("o"), "k", F.col("v").alias("wv"))
    return e.join(F.broadcast(w), "k").groupBy("vec_id", "o").agg(F.round(F.sum(F.col("v").cast("double") * F.col("wv").cast("double")), 6).alias("y"))


_TOKENS = """tokens as (select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::bigint as pos, token from (
  select doc_id, generate_subscripts(w, 1) as pos, (length(unnest(w)) % 32)::int as token from (select doc_id, list_filter(string_split(regexp_replace(text, '[\\t\\n\\x0B\\f\\r]', ' ', 'g'), ' '), lambda x: x <> '') as w from documents)))"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of words as a small vocabulary of 32 tokens: an array in order for each document."""
    words = F.filter(F.split(F.regexp_replace("text", r"[\t\n\x0B\f\r]", " "), " "), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda w: F.length(w) % 32).alias("tokens"))


def _windows(t: DataFrame) -> DataFrame:
    """(doc_id, win, tokens): windows of 128 tokens, cut from each array where it lies."""
    starts = F.expr("case when size(tokens) > 0 then sequence(0, (size(tokens) - 1) div 128) else array() end")
    return t.select("doc_id", "tokens", F.explode(starts).alias("win")).select("doc_id", F.col("win").cast("long").alias("win"), F.expr("slice(tokens, win * 128 + 1, 128)").alias("tokens"))


def _pairs(t: DataFrame, *keep: str) -> DataFrame:
    """(token, nxt) of each array's neighbours."""
    pair = F.explode(F.expr("arrays_zip(slice(tokens, 1, greatest(size(tokens) - 1, 0)), slice(tokens, 2, greatest(size(tokens) - 1, 0)))"))
    return t.select(*keep, pair.alias("p")).select(*keep, F.col("p.0").alias("token"), F.col("p.1").alias("nxt"))


@query("win7_next_token", f"with {_TOKENS} select token, nxt, count(*) as n from (select token, lead(token) over (partition by doc_id order by pos) as nxt from tokens) where nxt is not null group by all")
def win7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(_tokens(spark, sf_dir)).groupBy("token", "nxt").agg(F.count(F.lit(1)).alias("n"))


@query("win8_token_windows", f"with {_TOKENS} select doc_id, pos // 128 as win, count(*) as n, sum(token)::bigint as total from tokens group by all having count(*) >= 2")
def win8(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return _windows(_tokens(spark, sf_dir)).select("doc_id", "win", F.size("tokens").cast("long").alias("n"), total.alias("total")).where("n >= 2")


@query(
    "agg12_perplexity",
    f"""with {_TOKENS}, b as (select token, nxt, count(*) as n from (select token, lead(token) over (partition by doc_id order by pos) as nxt from tokens) where nxt is not null group by all),
    p as (select token, nxt, (n + 1.0) / (sum(n) over (partition by token) + 32.0) as p from b),
    s as (select doc_id, pos, token, lead(token) over (partition by doc_id, pos // 128 order by pos) as nxt from tokens)
    select doc_id, count(*) as n, round(exp(avg(-ln(p.p))), 6) as perplexity from s join p on p.token = s.token and p.nxt = s.nxt group by doc_id""",
)
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of a bigram model of word lengths over windows of 128 tokens."""
    t = _tokens(spark, sf_dir)
    b = _pairs(t).groupBy("token", "nxt").agg(F.count(F.lit(1)).alias("n"))
    p = b.select("token", "nxt", ((F.col("n") + 1.0) / (F.sum("n").over(W.partitionBy("token")) + 32.0)).alias("p"))
    s = _pairs(_windows(t), "doc_id").groupBy("doc_id", "token", "nxt").agg(F.count(F.lit(1)).alias("m"))
    s = s.join(F.broadcast(p), ["token", "nxt"])  # 32 x 32 rows at most
    return s.groupBy("doc_id").agg(F.sum("m").alias("n"), F.round(F.exp(F.sum(F.col("m") * -F.ln("p")) / F.sum("m")), 6).alias("perplexity"))


@query("win9_causal_prefix", f"with {_TOKENS} select doc_id, max(seen)::bigint as most from (select doc_id, sum(token) over (partition by doc_id, pos // 128 order by pos) as seen from tokens) group by doc_id")
def win9(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda a, x: F.struct((a["seen"] + x).alias("seen"), F.greatest(a["most"], a["seen"] + x).alias("most"))
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("most"))
    return _windows(_tokens(spark, sf_dir)).groupBy("doc_id").agg(F.max(F.aggregate("tokens", zero, step, lambda a: a["most"])).alias("most"))


@query("jn13_embedding_lookup", f"with {_TOKENS}, u as (select distinct token from tokens) select u.token, round(e.embedding[1]::double, 6) as first, len(e.embedding)::int as width from u join embeddings e on e.vec_id = u.token")
def jn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    u = _tokens(spark, sf_dir).select(F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    return u.join(e, F.col("vec_id") == F.col("token")).select("token", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.size("embedding").alias("width"))


@query("jn12_vocabulary_lookup", f"""with v as (select p_name as piece, min(p_partkey) as id from part group by p_name), w as (select p_partkey, p_name from part)
    select w.p_partkey, v.id from w join v on v.piece = w.p_name""")
def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces to ids; of equal pieces the lowest id counts."""
    p = table(spark, sf_dir, "part")
    v = p.groupBy(F.col("p_name").alias("piece")).agg(F.min("p_partkey").alias("id"))
    return p.join(v, F.col("p_name") == F.col("piece")).select("p_partkey", "id")
