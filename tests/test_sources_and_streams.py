"""Containers, snapshots, codecs in Spark, allocation, and the streaming processors."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorquay.functions import records as R
from tensorquay.functions.chunking import Params, cuts
from tensorquay.functions.text import BytePairs, pre_tokens
from tensorquay.operators import content, intervals, slots, trees
from tensorquay.sources import container as C
from tensorquay.streaming.processors import buffer_stream, chunk_stream


def fixture():
    pairs = [
        ("general.alignment", 4, 32),
        ("general.architecture", 8, "llama"),
        ("llama.block_count", 4, 2),
        ("llama.embedding_length", 4, 64),
        ("llama.attention.head_count", 4, 4),
        ("tokenizer.ggml.tokens", 9, (8, ["a", "b", "ab"])),
        ("tokenizer.ggml.token_type", 9, (5, [1, 1, 1])),
        ("tokenizer.ggml.merges", 9, (8, ["a b"])),
        ("nested", 9, (9, [(0, [1, 2]), (0, [])])),
        ("flag", 7, True),
    ]
    f16 = np.arange(64, dtype="<f2").tobytes()
    q8 = b"".join(np.float16(0.5).tobytes() + np.arange(-16, 16, dtype=np.int8).tobytes() for _ in range(4))
    return C.build(pairs, [("blk.0.attn_q.weight", [64], 1, f16), ("blk.0.ffn_down.weight", [32, 4], 8, q8)])


def test_container(spark, tmp_path):
    raw = fixture()
    c = C.parse(raw)
    assert c.value("nested") == [[1, 2], []] and c.value("flag") is True and c.data_offset % 32 == 0
    for bad in (b"", raw[:20], b"XXXX" + raw[4:], raw[:4] + b"\x09" + raw[5:]):
        with pytest.raises(C.ContainerError):
            C.parse(bad)
    (tmp_path / "good.gguf").write_bytes(raw)
    (tmp_path / "cut.gguf").write_bytes(raw[:40])
    h = C.headers(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.error is None for r in h.collect()} == {"good.gguf": True, "cut.gguf": False}
    kv = C.pairs(h)
    assert json.loads(C.pair_value(kv, "general.alignment").first().value) == 32
    assert C.tokenizer_pairs(kv).count() == 3
    config = C.model_config(kv).first()
    assert (config.layers, config.heads, config.kv_heads, config.rope_width, config.rope_base, config.context) == (2, 4, 4, 16, 10000.0, 0)
    assert [(r.id, r.token) for r in C.vocabulary(kv).orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "ab")]
    assert C.merges(kv).first()[1:] == (0, "a", "b")
    assert {r.name: r.dimensions for r in C.tensors(h).collect()} == {"blk.0.attn_q.weight": [64], "blk.0.ffn_down.weight": [32, 4]}
    C.register(spark)
    blocks = spark.read.format("weight_blocks").option("blocksPerSplit", 3).load(str(tmp_path / "good.gguf"))
    got = {(r.tensor, r.block): r.weights for r in blocks.collect()}
    assert len(got) == 68 and got["blk.0.ffn_down.weight", 3] == [0.5 * v for v in range(-16, 16)] and got["blk.0.attn_q.weight", 5] == [5.0]


def test_records_in_spark(spark):
    x = spark.createDataFrame([(3, 70000, 4096, 1)], "slot int, start long, bits long, flags int")
    p = x.select(R.packed_pointer(*(F.col(c) for c in x.columns)).alias("p"))
    a = p.select("p", R.packed_anchor(F.lit(9).cast("long"), F.col("p")).alias("a")).select(R.unpacked_pointer(F.col("p")).alias("p"), R.unpacked_anchor(F.col("a")).alias("a"), R.unpacked_anchor(F.concat(F.col("a").substr(1, 27), F.lit(b"\x00"))).alias("bad")).first()
    assert tuple(a.p) == (3, 70000, 4096, 1) and a.a.generation == 9 and a.bad is None


def test_snapshots(spark, tmp_path):
    s = content.Snapshots(spark, "file://" + str(tmp_path))
    assert s.commit({"t": spark.range(3)}) == 1
    assert s.commit({"t": spark.range(5)}, expected=1) == 2
    with pytest.raises(RuntimeError):
        s.commit({"t": spark.range(9)}, expected=1)
    assert s.read("t").count() == 5
    (tmp_path / "manifests" / "2.json").write_text("broken")
    for crc in (tmp_path / "manifests").glob(".*.crc"):
        crc.unlink()
    assert s.read("t").count() == 3  # the former generation is still there


def test_allocation_is_a_fold(spark):
    runs = spark.createDataFrame([(1, 0, 0, 100, 1.0, 0.0), (1, 0, 500, 10, 2.0, 0.0)], "pool long, slot int, start long, length long, ceiling double, salience double")
    req = spark.createDataFrame([(1, 1, 80), (1, 2, 800), (1, 3, 80), (1, 4, 9999)], "pool long, req long, bits long")
    got = {r.req: (r.slot, r.start, r.length) for r in intervals.allocate(req, runs, 8).collect()}
    assert got == {1: (0, 0, 10), 2: (None, None, 100), 3: (0, 10, 10), 4: (None, None, 1250)}


@pytest.mark.parametrize("dirty", [False, True])
def test_allocation_against_a_plain_fold(spark, dirty):
    rng = random.Random(dirty)
    rows = [(p, 0, i * 200, rng.randint(0, 150), float(rng.randint(1, 3)) if p else i % 700 / 7, rng.randint(0, 1) / 2) for p in range(3) for i in range(900)]
    rows = [(*r, rng.randint(0, r[3]) * rng.randint(0, 1)) for r in rows]
    reqs = [(p, q, rng.choice([0, 1, rng.randint(1, 1200), 1199])) for p in range(4) for q in range(700)]
    want = {}
    for pool in range(4):
        free = [[c, s, n, slot, start, d * dirty] for p, slot, start, n, c, s, d in rows if p == pool]
        for _, q, bits in sorted(r for r in reqs if r[0] == pool):
            need = -(-bits // 8)
            fit = min((f for f in free if f[5] >= need > 0), default=None) or min((f for f in free if f[2] >= need > 0), default=None)
            want[pool, q] = (*(fit[3:5] if fit else (None, None)), need)
            if fit and fit[2] == need:
                free.remove(fit)
            elif fit:
                fit[2], fit[4], fit[5] = fit[2] - need, fit[4] + need, max(0, fit[5] - need)
    names = ["pool long", "slot int", "start long", "length long", "ceiling double", "salience double", "dirty long"]
    runs = spark.createDataFrame([r if dirty else r[:6] for r in rows], ", ".join(names if dirty else names[:6]))
    got = intervals.allocate(spark.createDataFrame(reqs, "pool long, req long, bits long"), runs, 8)
    assert {(r.pool, r.req): (r.slot, r.start, r.length) for r in got.collect()} == want


def test_allocation_reads_no_run_twice():
    """The work of a request does not grow with the runs: many of both end soon."""
    n = 200_000
    at = np.arange(n)
    free = intervals.Shelves([at % 977 / 7.0, at % 10 / 10.0, at % 112 + 1, at % 1, at * 200, at * 0])
    began = time.process_time()
    for q in range(5000):
        c, s, length, slot, start, _ = free.take(need := q * 37 % 112 + 1, False)
        if length > need:
            free.put((c, s, length - need, slot, start + need, 0))
    assert time.process_time() - began < 20  # 5000 times 200,000 runs take minutes


def test_trees(spark):
    f = spark.createDataFrame([("/a/b/x.txt", "one"), ("/a/y.txt", "two")], "path string, content string")
    e = trees.from_files(f)
    assert [r.path for r in trees.walked(e).collect()] == ["/a", "/a/b", "/a/b/x.txt", "/a/y.txt"]
    new, said = trees.made_directories(e, spark.createDataFrame([("/a/c",), ("/q/r",), ("/a/b",), ("/a/y.txt/z",), ("/a/..",)], "path string"))
    assert {r.path: r.outcome for r in said.collect()} == {"/a/c": "made", "/q/r": "no_parent", "/a/b": "exists", "/a/y.txt/z": "not_a_directory", "/a/..": "dots"}
    left, said = trees.removed_directories(new, spark.createDataFrame([("/a/c",), ("/a/b",), ("/zz",)], "path string"))
    assert {r.path: r.outcome for r in said.collect()} == {"/a/c": "removed", "/a/b": "not_empty", "/zz": "missing"} and left.count() == 4
    assert trees.unlinked(e, spark.createDataFrame([("/a/y.txt",), ("/a",)], "path string"))[0].count() == 3


def test_pre_tokens_and_merges(spark):
    texts = ["abc123def", "hello   world", "don't worry", "It's 3:14pm", "a\n\nb", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pre_tokens(F.col("t")).alias("p")).collect()
    got = {r.t: r.p for r in rows}
    assert got["abc123def"] == ["abc", "1", "2", "3", "def"] and got["hello   world"] == ["hello", "  ", " world"]
    assert got["don't worry"] == ["don", "'t", " worry"] and all("".join(p) == t for t, p in got.items())
    bp = BytePairs({"a": 0, "b": 1, "ab": 2, "aa": 3, "aab": 4, "Ġ": 5, "<s>": 6}, [("a", "a"), ("a", "b"), ("aa", "b")], begin=6)
    assert bp.encode(["aab", " a", "aaa"], add_begin=True) == [6, 4, 5, 0, 3, 0] and bp.decode([4, 5, 0]) == "aab a"
    with pytest.raises(KeyError):
        bp.encode(["z"])


def run_stream(spark, df, folder, transform, name):
    df.repartition(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_chunk_stream(spark, tmp_path):
    rng, p = random.Random(2), Params(32, 64, 128)
    data = {i: rng.randbytes(700 + 100 * i) for i in range(3)}
    rows = [(i, s, d[s * 90 : s * 90 + 90], (s + 1) * 90 >= len(d)) for i, d in data.items() for s in range(-(-len(d) // 90))]
    df = spark.createDataFrame(rows, "stream long, seq long, data binary, last boolean")
    got = run_stream(spark, df, str(tmp_path), lambda s: chunk_stream(s, p), "chunks")
    ends = {i: sorted(r.start + r.length for r in got if r.stream == i) for i in data}
    assert ends == {i: cuts(d, p) for i, d in data.items()}


def test_buffer_stream(spark, tmp_path):
    rows = [(1, 1, 0, b"abc", "write"), (1, 2, 5, b"z", "write"), (1, 3, 0, b"", "flush"), (1, 4, 2, b"", "truncate"), (1, 5, 0, b"", "release"), (2, 1, 0, b"q", "write")]
    df = spark.createDataFrame(rows, "file long, seq long, offset long, data binary, op string")
    got = run_stream(spark, df, str(tmp_path), buffer_stream, "buffers")
    assert sorted((r.file, r.seq, r.size, r.revision) for r in got) == [(1, 3, 6, 2), (1, 5, 2, 3)]


def test_slots_page_join(spark):
    t = spark.createDataFrame([("blk.0.ffn_up.weight", [3], 1, 0), ("blk.1.ffn_up.weight", [5], 0, 0), ("blk.0.attn_q.weight", [4], 14, 0), ("x", [1], 10, 0)], "name string, dimensions array<long>, raw_type int, data_offset long")
    m = slots.slot_map(slots.planned(t))
    assert [(r.name, r.bit_start, r.bit_end) for r in m.orderBy("slot").collect()] == [("blk.1.ffn_up.weight", 0, 40), ("blk.0.ffn_up.weight", 40, 52), ("blk.0.attn_q.weight", 52, 60)]
    at = slots.locate(spark.range(60).withColumnRenamed("id", "bit"), m).orderBy("bit").collect()
    assert len(at) == 60 and (at[45].slot, at[45].weight, at[45].weight_bit) == (1, 1, 1)


def _random_runs(seed, n=300, overlap=False):
    rng, out, at = random.Random(seed), [], [0, 0, 0]
    for _ in range(n):
        s = rng.randrange(3)
        start = max(0, at[s] + rng.choice([0, 0, 1, 7, 90]) - (rng.randint(0, 20) if overlap else 0))
        length = rng.choice([1, 2, 5, 30, 200])
        out.append((s, start, length, rng.random(), rng.random()))
        at[s] = start + length
    return out


@pytest.mark.parametrize("segment", [1, 16, 1 << 20])
def test_runs_over_segments(spark, segment):
    """Merging, subtracting and neighbours don't depend on where segments end."""
    columns = "slot int, start long, length long, ceiling double, salience double"
    apart, over, taken = _random_runs(1), _random_runs(2, overlap=True), _random_runs(3, 60)
    cells = lambda runs: {(s, a) for s, b, n, *_ in runs for a in range(b, b + n)}

    def islands(have):
        return sorted((s, a, next(n for n in range(1, len(have) + 2) if (s, a + n) not in have)) for s, a in have if (s, a - 1) not in have)

    df = spark.createDataFrame(over, columns)
    got = sorted(intervals.merged(df, segment).collect())
    assert [tuple(r[:3]) for r in got] == islands(cells(over))
    assert all(r.ceiling == max(c for s, a, _, c, _ in over if s == r.slot and r.start <= a < r.start + r.length) for r in got)
    left = intervals.subtracted(spark.createDataFrame(apart, columns), spark.createDataFrame(taken, columns), segment)
    assert sorted(map(tuple, left.collect())) == islands(cells(apart) - cells(taken))
    ends = {(s, b + n) for s, b, n, *_ in apart}
    starts = {(s, b) for s, b, *_ in apart}
    near = intervals.neighbours(spark.createDataFrame(apart, columns), segment).collect()
    assert sorted(map(tuple, near)) == sorted((s, b, n, (s, b) in ends, (s, b + n) in starts) for s, b, n, *_ in apart)


def test_best_fits_and_numbers(spark):
    rng = random.Random(9)
    runs = [(rng.randrange(5), i, rng.choice([1, 2, 63, 64, 65, 127, 128, 129, 4000]) + rng.randrange(3), rng.randrange(4) / 4, rng.random()) for i in range(80)]
    requests = [(i, rng.choice([0, 1, 8, 511, 512, 513, 1023, 1024, 32_000, 10**6])) for i in range(60)]
    df = spark.createDataFrame(runs, "slot int, start long, length long, ceiling double, salience double")
    got = {r.req: (r.ceiling, r.salience, r.length, r.slot, r.start) for r in intervals.best_fits(spark.createDataFrame(requests, "req long, bits long"), df, 8).collect()}
    order = [(c, s, n, slot, a) for slot, a, n, c, s in runs]
    assert got == {i: min((o for o in order if o[2] >= -(-b // 8)), default=(None,) * 5) for i, b in requests}
    words = [rng.choice("abcde") * rng.randint(0, 9) for _ in range(200)]
    rank = {w: i + 1 for i, w in enumerate(sorted(set(words)))}
    out = trees.numbered(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert sorted((r.w, r.number) for r in out) == sorted((w, rank[w]) for w in words)
