"""URL filters (operator 7), native: rules by host and path, and logistic regression on hashed n-grams.

A URL's host and path come from string functions.  The rules are a small table; of those that fit (the
host or a domain above it, and the beginning of the path) the longest decides.  Other URLs get the
verdict of a logistic regression on hashed character n-grams of host and path.  It is trained from a
small labelled table of URLs, whose n-grams DataFrame functions make; the fit itself, over at most
MOST_LABELLED rows, runs in the driver.  Weights are whole numbers, so a score does not depend on the
order of its terms.  The table that is used if none is given is made by a rule (``labelled``): names of
common words and of syllables against names of words that advertise, on the same domains, in the same
languages and with the same paths, so that only names tell them apart.

Defined cases: a null URL, or one without ``://``, has empty host and path and is judged by the model
(the score of no n-grams is the bias); repeated rows are judged one by one; long URLs are read whole; an
empty table gives an empty table; other columns are kept, and host, path, rule, verdict and logit take the
place of columns of these names.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host/path prefix, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Words of hosts that advertise, and of others.
UNWANTED = """casino bet bets poker slots win bonus jackpot free cheap pills viagra pharmacy adult xxx sex porn ads adserver
    track click banner popup spam farm replica loan payday crack keygen warez""".split()
WANTED = """library school garden history science kitchen travel forum museum weather music recipes physics local news city
    health sport books art docs tools reading language river theatre station market village house nature writer letter north
    education children family report journal university""".split()
_SUBS = ("", "www.", "m.", "blog.", "", "news.")
_TOPS = (".example.com", ".example.net", ".example.org", ".com", ".net", ".de", ".fr", ".es")
_PATHS = ("/{}/{}", "/{}/{}.html", "/{}/{}/", "/{}/{}/page")
_LANGS = ("en", "de", "fr", "es")
MOST_LABELLED = 10_000
#: Slots of the hashed trigrams; weights are in millionths.
DIMS, SCALE = 16_384, 1_000_000
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def labelled() -> tuple[tuple[str, int], ...]:
    """Labelled URLs (1: keep): each name once, on domains and paths in turn."""
    syllables = [c + v + e for c in "b c d f g h k l m n p r s t th sh w st".split() for v in "aeiou" for e in ("", "n", "r", "s", "l", "t")]
    names = [(w, 1) for w in WANTED]
    names += [(a + sep + WANTED[(i * 7 + 3 * j + 1) % len(WANTED)], 1) for i, a in enumerate(WANTED) for j, sep in enumerate(("-", ""))]
    pick = lambda i, k: syllables[i * (101 + 36 * k) % len(syllables)]
    names += [("".join(pick(i + 17 * k, k) for k in range(2 + i % 2)), 1) for i in range(1, 301)]
    names += [(a + sep + UNWANTED[(i + step) % len(UNWANTED)], 0) for i, a in enumerate(UNWANTED) for step, sep in ((1, "-"), (4, "-"), (9, ""), (13, "-"), (17, ""), (22, "-"))]
    out = []
    for i, (name, label) in enumerate(sorted(names, key=lambda x: zlib.crc32(x[0].encode()))):  # labels mixed
        path = _PATHS[i // 3 % len(_PATHS)].format(_LANGS[i % len(_LANGS)], i * 7919 % 9973)
        out.append((("http", "https")[i % 2] + "://" + _SUBS[i % len(_SUBS)] + name + _TOPS[i // 2 % len(_TOPS)] + path, label))
    return tuple(out)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, _AZ, _az), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def with_slots(df: DataFrame, dims: int = DIMS) -> DataFrame:
    """``df`` (with host, path) with slots: those of the character trigrams of host (odd) and path (even).

    Characters become codes in a projection of their own, so that none is computed twice.
    """
    marked = lambda c: F.concat(F.lit("^"), F.col(c), F.lit("$"))
    codes = lambda c: F.transform(F.split(marked(c), ""), lambda x: F.ascii(x).cast("long"))
    x = df.withColumns({"host_codes": codes("host"), "path_codes": codes("path")})

    def of(text: str, half: int) -> Column:
        c = F.col(f"{text}_codes")
        after = lambda k: F.slice(c, k + 1, F.greatest(F.size(c) - 2, F.lit(0)))
        pairs = F.zip_with(after(0), after(1), lambda a, b: (a * 31 + b) * 31)
        slots = F.zip_with(pairs, after(2), lambda a, b: ((a + b) * 2654435 % 1000003 % (dims // 2) * 2 + half).cast("int"))
        return F.when(F.length(text) > 0, slots).otherwise(F.array().cast("array<int>"))

    return x.withColumn("slots", F.concat(of("host", 1), of("path", 0))).drop("host_codes", "path_codes")


def fitted(rows: list[tuple[list[int], int]], dims: int = DIMS, epochs: int = 12, rate: float = 0.2) -> list[int]:
    """Weights in millionths, the bias last: a few passes of gradient steps on the logistic loss, each slot's
    step shrinking with its gradients so far, over few rows in the order given."""
    weight, seen = [0.0] * (dims + 1), [1e-3] * (dims + 1)
    inputs = []
    for slots, label in rows:
        share: dict[int, float] = {}
        for s in slots:
            share[s] = share.get(s, 0.0) + 8 / len(slots)
        inputs.append(([*sorted(share.items()), (dims, 1.0)], label))
    for _ in range(epochs):
        for x, label in inputs:
            z = sum(v * weight[s] for s, v in x)
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
            for s, v in x:
                g = miss * v
                seen[s] += g * g
                weight[s] -= rate * g / math.sqrt(seen[s])
    return [round(w * SCALE) for w in weight]


def trained(labelled: DataFrame, url: str = "url", label: str = "label") -> list[int]:
    """Weights from a small labelled table (MOST_LABELLED rows at most, else an error)."""
    host, path = host_and_path(url)
    x = with_slots(labelled.select(host.alias("host"), path.alias("path"), F.col(label).cast("int").alias("label"), url))
    rows = x.select("slots", "label", url).limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"the labelled table has more than {MOST_LABELLED} rows")
    return fitted([(r["slots"], r["label"]) for r in sorted(rows, key=lambda r: (r[url] or "", r["label"]))])


def logit(slots: Column, weights: list[int]) -> Column:
    """The model's score of a URL, whose sign is its verdict: an integer sum over the n-grams."""
    table = F.split(F.lit(",".join(map(str, weights[:-1]))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate(slots, F.lit(0).cast("long"), lambda a, s: a + F.get(table, s))
    return total * 8 + F.lit(weights[-1]).cast("long") * F.greatest(F.size(slots), F.lit(1))


RESULT = ("host", "path", "rule", "verdict", "logit")


def judge(pages: DataFrame, weights: list[int], url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and logit, which take the place of columns of these names."""
    names = [c for c in pages.columns if c not in RESULT or c == url]
    x = pages.select(F.col(f"`{url}`").alias("judged_url"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    host, path = host_and_path("judged_url")
    x = x.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = with_slots(x.withColumn("rule", rule).withColumn("says", verdict)).withColumn("logit", logit(F.col("slots"), weights))
    x = x.withColumn("verdict", F.coalesce("says", F.when(F.col("logit") >= 0, "allow").otherwise("block")))
    return x.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in RESULT), *RESULT)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(list(labelled()), "url string, label int")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, trained(known)).select("page_id", *RESULT)


def _slots_of(text: str, half: int) -> list[int]:
    """The slots of one string, for the SQL below."""
    if not text:
        return []
    codes = [ord(c) for c in f"^{text}$"]
    return [((a * 31 + b) * 31 + c) * 2654435 % 1000003 % (DIMS // 2) * 2 + half for a, b, c in zip(codes, codes[1:], codes[2:])]


def _split(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)(/[^?#]*)?", rest)
    return m[1].lower(), m[2] or ""


def plain_rows(known: tuple[tuple[str, int], ...]) -> list[tuple[list[int], int]]:
    """(slots, label) of labelled URLs, for ``fitted``, in the order of ``trained``."""
    return [(_slots_of(host, 1) + _slots_of(path, 0), label) for url, label in sorted(known) for host, path in [_split(url)]]


def plain_logit(url: str, weights: list[int]) -> int:
    """The model's score of one URL."""
    host, path = _split(url or "")
    slots = _slots_of(host, 1) + _slots_of(path, 0)
    return sum(weights[s] for s in slots) * 8 + weights[-1] * max(1, len(slots))


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows, with the fitted weights as a list."""
    weights = fitted(plain_rows(labelled()))
    listed = ", ".join(map(str, weights[:-1]))
    rule, says = "null", "null"
    for text, verdict in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = f"(host = '{domain}' or host like '%.{domain}') and starts_with(path, '{slash + rest}')"
        rule, says = f"case when {fits} then '{text}' else {rule} end", f"case when {fits} then '{verdict}' else {says} end"
    slots = lambda c, half: f"case when {c} = '' then []::bigint[] else list_transform(range(1, length({c}) + 1), lambda i: ((unicode(substr('^' || {c} || '$', i, 1)) * 31 + unicode(substr('^' || {c} || '$', i + 1, 1))) * 31 + unicode(substr('^' || {c} || '$', i + 2, 1)))::bigint * 2654435 % 1000003 % {DIMS // 2} * 2 + {half}) end"
    return f"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
s as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_AZ}', '{_az}') as host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from u),
g as (
  select *, list_concat({slots("host", 1)}, {slots("path", 0)}) as slots, {rule} as rule, {says} as says from s),
k as (
  select [{listed}]::bigint[] as weight),
l as (
  select page_id, host, path, rule, says,
         (coalesce(list_sum(list_transform(slots, lambda s: weight[s + 1])), 0) * 8 + {weights[-1]}::bigint * greatest(len(slots), 1))::bigint as logit
  from g, k)
select page_id, host, path, rule, coalesce(says, case when logit >= 0 then 'allow' else 'block' end) as verdict, logit from l
"""
