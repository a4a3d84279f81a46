"""Queries without SQL against plain versions that read every row."""

import json
import zlib

import numpy as np
import pytest

from tensorquay.catalog import QUERIES
from tensorquay.plans.containers import _decoder
from tensorquay.plans.storage import lossy


@pytest.fixture
def documents(spark, tmp_path):
    """A folder with a table of a few documents, and its rows."""
    rows = [(1, "en", "a", "plain words"), (7, "de", "b", "gr\u00fc\u00dfe " * 50), (20, "fr", "a", None), (33, "en", "b", ""), (40, "es", "a", "x" * 20_000)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_stat_of_every_file(spark, documents):
    folder, rows = documents
    want = []
    for doc, lang, source, text in rows:
        raw = (text or "").encode()
        want.append({"path": f"/{lang}/{source}/{doc}.txt", "kind": "file", "size_bytes": len(raw), "crc32": f"{zlib.crc32(raw):08x}"})
    got = [json.loads(r["payload"]) for r in QUERIES["ask3_stat_crc"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_compensation_of_every_line(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 64))
    spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x.astype(np.float32).astype(float)
    lines = [(int(o), int(n), int(p), int(s)) for o, n, p, s in zip(rng.integers(0, 500, 400), rng.integers(1, 8, 400), rng.integers(0, 100, 400), rng.integers(0, 10, 400))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    regions = {}
    for o, n, p, s in lines:
        delta = 0.0 if n == 1 else n * 0.25 - 1
        if delta and o % 64 < 8:
            r = regions.setdefault((s % 2, p % 50), {})
            r[o % 64] = r.get(o % 64, 0.0) + delta
    want = {}
    for (layer, out), r in regions.items():
        own = x[layer::2]
        h = own.T @ own / len(own)
        taken, free = sorted(r), [c for c in range(64) if c not in r]
        change = -np.linalg.solve(h[np.ix_(free, free)], h[np.ix_(free, taken)]) @ np.array([r[c] for c in taken])
        want |= {(f"blk.{layer}.attn_q.weight", out, c): v for c, v in zip(free, change)}
    got = {(r["tensor"], r["out_channel"], r["channel"]): r["change"] for r in QUERIES["df25_compensated_write"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.fixture
def turns(spark, tmp_path):
    """A folder with turns of several lengths, two beyond the decoder's usual context, and their tokens."""
    rng = np.random.default_rng(9)
    ids = {(1, 0): 2, (1, 1): 256, (2, 0): 257, (2, 1): 300, (3, 0): 700, (4, 0): 2100, (4, 1): 2500}
    ids = {k: rng.integers(1, 32, n) for k, n in ids.items()}
    rows = [(c, t, "user", " ".join("w" * i for i in v.tolist())) for (c, t), v in ids.items()]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path), ids


def test_forward_pass_of_whole_turns(spark, turns):
    folder, ids = turns
    got = {(r["conv_id"], r["turn"]): (r["token"], r["perplexity"]) for r in QUERIES["df22_forward_pass"](spark, folder).collect()}
    model = _decoder()
    assert got.keys() == ids.keys()
    for k, v in ids.items():
        assert got[k][0] == int(model.run(v, last_only=True)[0].argmax())
        losses = []
        for a in range(0, len(v), 64):
            z = model.run(v[a : a + 64]).astype(float)[:-1]
            losses += (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), v[a + 1 : a + 64]]).tolist()
        assert abs(got[k][1] - np.exp(np.mean(losses))) < 2e-3


def test_calibration_of_whole_turns(spark, turns):
    folder, ids = turns
    model, sums = _decoder(), {}

    def observe(site, layer, x):
        s = sums.setdefault((site, layer), [0, 0])
        s[0] += np.abs(x).astype(float).sum(axis=0)
        s[1] += len(x)

    for v in ids.values():
        model.run(v, observe=observe)
    got = {(r["tensor"], r["channel"]): r["salience"] for r in QUERIES["df24_calibrate"](spark, folder).collect()}
    for role, site in (("attn_q", "qkv_input"), ("attn_output", "attn_output_input"), ("ffn_up", "ffn_gate_up_input"), ("ffn_down", "ffn_down_input")):
        for layer in range(2):
            total, n = sums[site, layer]
            assert n == sum(map(len, ids.values()))
            assert all(abs(got[f"blk.{layer}.{role}.weight", c] - v / n) < 2e-4 for c, v in enumerate(total))


def test_lossy_text_of_whole_files(spark, documents):
    folder, rows = documents
    got = {r["doc_id"]: r["text"] for r in QUERIES["fn34_lossy_text"](spark, folder).collect()}
    assert got == {doc: text or "" for doc, _, _, text in rows}
    raw = [b"a" * 150 + b"\xff\xfeb", "é".encode() * 80 + b"\xe2\x82", b""]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw binary")
    assert [r["t"] for r in df.orderBy("i").select(lossy(df["raw"]).alias("t")).collect()] == ["a" * 150 + "\ufffd\ufffdb", "é" * 80 + "\ufffd", ""]
