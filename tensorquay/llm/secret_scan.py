"""Secret scans (operator 4).

An Aho-Corasick automaton over all keywords reads each text once; only where one hits are the
regular expressions of its kinds tried, anchored at the hit.  Kinds whose tokens carry a checksum
are kept only if it holds.  Long runs of hexadecimal digits have no keyword: their own scan is one
pass of a character class.

Spans are in code points, end exclusive.  Within a kind matches are leftmost and do not overlap, and
a match that is too short still takes its place, as a scan of the kind's expression alone would do.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; texts are
scanned whole, however long; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_kernels import tidy

BASE = ("assign", "access", "hex")
#: What redaction puts in place of a span.
MASK = "<secret>"

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _ALPHABET[r] + out
    return out.rjust(width, "0")


def crc_holds(m: re.Match) -> bool:
    """Prefixed tokens end in the CRC-32 of their random part, as six base-62 digits."""
    body = m.group(1)
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def luhn_holds(m: re.Match) -> bool:
    digits = [int(c) for c in m.group(1)]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def jwt_holds(m: re.Match) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    part = m.group(1)
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(head, dict) and "alg" in head


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]
    any_case: bool = False


#: Kinds with keywords, the base ones first; then tokens whose form, checksum or structure proves them.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 6, any_case=True),
    Kind("access", ("AKIA",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group(0)) >= 20),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), crc_holds),
    Kind("npm", ("npm_",), re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), crc_holds),
    Kind("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), re.compile(r"xox[bpar]-[0-9]{10,13}-[0-9A-Za-z-]{10,}"), lambda m: True),
    Kind("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"), lambda m: True),
    Kind("jwt", ("eyJ",), re.compile(r"(eyJ[0-9A-Za-z_-]+)\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+"), jwt_holds),
    Kind("pem", ("-----BEGIN ",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[0-9A-Za-z+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"), lambda m: True),
    Kind("card", ("card number", "card no"), re.compile(r"card n(?:umber|o)[.:]? ?([0-9]{13,19})(?![0-9])", re.I | re.A), luhn_holds, any_case=True),
)
_HEX = re.compile(r"[0-9a-f]{24,}")
ORDER = ("assign", "access", "hex", *(k.name for k in KINDS[2:]))


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, kind in enumerate(KINDS):
        for word in kind.keywords:
            a.add_word(word.lower(), (i, len(word), word))
    a.make_automaton()
    return a


_cached: list[ahocorasick.Automaton] = []


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, by start, then in the order of the kinds."""
    if not text:
        return []
    if not _cached:
        _cached.append(_automaton())
    found, hits = [], []
    for end, (i, n, word) in _cached[0].iter(lower_ascii(text)):
        start = end + 1 - n
        if KINDS[i].any_case or text.startswith(word, start):
            hits.append((start, i))
    if hits:
        hits.sort()
        free = [0] * len(KINDS)
        for start, i in hits:
            if start < free[i]:
                continue
            if m := KINDS[i].pattern.match(text, start):
                free[i] = m.end()
                if KINDS[i].holds(m):
                    found.append((KINDS[i].name, start, m.end()))
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], ORDER.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, mask: str = MASK) -> str | None:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    if not (spans := scan(text)):
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end) for each row of ``docs``."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], names=["doc_id", "spans"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret in text masked, and n_chars (if there) counted anew where text changed."""

    names = docs.columns
    at = names.index("text")
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names with dots can't be looked up

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t.as_py()) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = inner.mapInArrow(tidy(run), inner.schema)
    if "n_chars" in names:
        n = f"c{names.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col(f"c{at}").contains(MASK), F.length(f"c{at}")).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*names)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
