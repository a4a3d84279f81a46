"""The pipeline against a plain Python version of all five stages, and its behaviour on odd tables."""

import collections
import re

import duckdb
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from tensorquay.llm import mixing, quality_rules, secret_scan, sentencepiece_codec

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ratios(t):
    w = WORD.findall(t)
    g = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j + d for j in range(len(w) - 2) if g[tuple(w[j : j + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    found = {"r_symbols": sum(c in "#*$%&|<>" for c in t), "r_bangs": t.count("!"), "r_upper": sum("A" <= c <= "Z" for c in t), "r_repeat": len(hit), "r_dup_lines": len(lines) - len(set(lines))}
    r = {name: max(1, (x + 1) * quality_rules.PER // max(1, n)) for name, x in found.items()}
    return n, len(hit), r


def low(x):
    """The least number of x's sketch bucket."""
    if x < 64:
        return x
    shift = x.bit_length() - 6
    return x >> shift << shift


def quartile(values, q):
    values = sorted(map(low, values))
    return values[next(i for i in range(len(values)) if i + 1 >= q * len(values))]


def plain_quality(rows):
    found = [(r, *ratios(r["text"] or "")) for r in rows]
    groups = collections.defaultdict(list)
    for r, n, hit, x in found:
        if n >= 50 and 100 * hit <= 50 * n:
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                groups[key].append(x)
    kept = []
    for r, n, hit, x in found:
        if n < 50 or 100 * hit > 50 * n:
            continue
        key = next((k for k in ((r["lang"], r["source"]), (r["lang"],)) if len(groups[k]) >= quality_rules.LEAST_GROUP), ())
        fits = True
        for name, (_, halves) in quality_rules.RATIOS.items():
            values = [v[name] for v in groups[key]]
            q1, q3 = quartile(values, 0.25), quartile(values, 0.75)
            fits &= x[name] <= q3 * max(q3 / q1, quality_rules.LEAST_FACTOR) ** (halves / 2)
        if fits:
            kept.append(r)
    return kept


def plain_near(rows):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        k = find(i)
        best[k] = min(best.get(k, r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] == best[find(i)]]


def test_against_plain_version(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = plain_near(plain_quality(docs))
    rows = [r | {"text": secret_scan.redacted(r["text"])} for r in rows]
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(rows))
    rel = con.sql(mixing.ORACLE_MIX_SOURCES)
    at = {c: i for i, c in enumerate(rel.columns)}
    times = {r[at["doc_id"]]: r[at["taken"]] // r[at["size"]] for r in rel.fetchall()}
    ref = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = collections.Counter()
    for r in rows:
        want[r["doc_id"], r["lang"], r["source"], tuple(ref.encode(r["text"]))] += times[r["doc_id"]]
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in got) == +want
    assert all(r.round_trip and r.parity_misses == 0 and r.n_tokens == len(r.ids) for r in got) and 100 < len(got)


def test_stages_keep_columns_and_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, h int, stays boolean"
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(1, long, None, None, len(long), "x", 1, True), (2, long + " end", "en", "a", None, "x", 1, True), (None, None, "en", None, None, None, None, None), (3, "", "en", "a", 0, "y", 2, False), (4, " ".join(f"w{i}" for i in range(80)), "en", "a", 1, "z", 3, None), (4, " ".join(f"w{i}" for i in range(80)), "en", "a", 1, "z", 3, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.schema.names == docs.schema.names, name
                docs = spark.createDataFrame(out.collect(), schema)
        result = out.collect()
        assert {r.doc_id for r in result} == ({1, 4} if data else set())
