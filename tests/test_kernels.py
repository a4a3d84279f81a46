"""Numpy kernels against plain definitions."""

import random

import numpy as np
import pytest

from tensorquay.functions import linalg as L
from tensorquay.functions import quant as Q
from tensorquay.functions import records as R
from tensorquay.functions.chunking import GEAR, Chunker, Params, cuts
from tensorquay.functions.tensor import Decoder


def plain_cuts(data, p):
    out, start, bits = [], 0, p.average.bit_length() - 1
    while start < len(data):
        n = len(data) - start
        end = n
        if n > p.least:
            end, h = min(n, p.most), 0
            for i in range(p.least, end):
                h = ((h << 1) + int(GEAR[data[start + i]])) % 2**64
                if h & ((1 << (bits + 1 if i < p.average else bits - 1)) - 1) == 0:
                    end = i
                    break
        start += end
        out.append(start)
    return out


@pytest.mark.parametrize("p", [Params(), Params(32, 64, 128), Params(64, 256, 1024)])
def test_cuts(p):
    rng = random.Random(3)
    for n in (0, 1, 31, 32, 33, 100, 1023, 1024, 1025, 4095, 4096, 4097, 16384, 16385, 40000):
        for data in (bytes(n), bytes((13 * i + 7) % 256 for i in range(n)), rng.randbytes(n)):
            assert cuts(data, p) == plain_cuts(data, p)


def test_gear_fixed_points():
    assert [hex(int(GEAR[i])) for i in (0, 1, 255)] == ["0x161922c645ce50e8", "0xad760cafa1697b60", "0xea2be3a8adbd94da"]


def test_pieces_equal_whole():
    rng = random.Random(5)
    p = Params(32, 64, 128)
    for _ in range(50):
        data = rng.randbytes(rng.randint(0, 3000))
        c, out, at = Chunker(p), [], 0
        while at < len(data):
            step = rng.randint(1, 200)
            out += c.feed(data[at : at + step])
            at += step
        out += c.finish()
        ends = np.cumsum([len(x) for x in out]).tolist()
        assert b"".join(out) == data and ends == plain_cuts(data, p)


def half(b):
    return float(np.frombuffer(bytes(b), "<f2")[0])


def scale_pair(j, s):
    if j < 4:
        return s[j] & 63, s[j + 4] & 63
    return (s[j + 4] & 15) | (s[j - 4] >> 6 << 4), (s[j + 4] >> 4) | (s[j] >> 6 << 4)


def plain_value(kind, b, w):
    if kind == "Q8_0":
        return half(b[:2]) * np.int8(np.uint8(b[2 + w]))
    if kind in ("Q4_K", "Q5_K"):
        run, place = divmod(w, 64)
        sub = 2 * run + place // 32
        sc, m = scale_pair(sub, b[4:16])
        q = b[(16 if kind == "Q4_K" else 48) + run * 32 + place % 32] >> (place // 32 * 4) & 15
        if kind == "Q5_K":
            q |= (b[16 + place % 32] >> sub & 1) << 4
        return half(b[:2]) * sc * q - half(b[2:4]) * m
    n, place = divmod(w, 128)
    part, l = divmod(place, 32)
    if kind == "Q6_K":
        low = b[n * 64 + l + part % 2 * 32] >> (part // 2 * 4) & 15
        q = (low | (b[128 + n * 32 + l] >> 2 * part & 3) << 4) - 32
        return half(b[208:210]) * int(np.int8(np.uint8(b[192 + n * 8 + l // 16 + part * 2]))) * q
    i = n * 8 + part * 2 + l // 16
    s = b[96:108]
    low = s[i % 8] >> (i // 8 * 4) & 15
    high = s[8 + i % 4] >> (i // 4 * 2) & 3
    q = (b[32 + n * 32 + l] >> 2 * part & 3) - (0 if b[l] >> (n * 4 + part) & 1 else 4)
    return half(b[108:110]) * ((low | high << 4) - 32) * q


@pytest.mark.parametrize("kind", ["Q8_0", "Q3_K", "Q4_K", "Q5_K", "Q6_K"])
def test_dequantize(kind):
    rng = random.Random(kind)
    size, n = Q.BLOCK_BYTES[kind], 32 if kind == "Q8_0" else 256
    blocks = []
    for _ in range(3):
        b = bytearray(rng.randbytes(size))
        for at in {"Q8_0": (0,), "Q3_K": (108,), "Q6_K": (208,)}.get(kind, (0, 2)):
            b[at : at + 2] = np.float16(rng.uniform(-2, 2)).tobytes()
        blocks.append(bytes(b))
    got = Q.dequantized(kind, b"".join(blocks)).reshape(3, n)
    want = [[plain_value(kind, b, w) for w in range(n)] for b in blocks]
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("kind,bits,n", [("F16", 4, 1), ("F32", 8, 1), ("Q8_0", 4, 32), ("Q3_K", 1, 256), ("Q4_K", 1, 256), ("Q5_K", 1, 256), ("Q6_K", 2, 256)])
def test_payload_round_trip(kind, bits, n):
    rng = random.Random(1)
    block = rng.randbytes(Q.BLOCK_BYTES[kind])
    payload = rng.randbytes(-(-n * bits // 8))
    out = Q.write_bits(kind, block, range(n), bits, payload)
    back = Q.read_bits(kind, out, range(n), bits)
    assert len(out) == len(block)
    want = np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little")[: n * bits]
    assert (np.unpackbits(np.frombuffer(back, np.uint8), bitorder="little")[: n * bits] == want).all()
    assert Q.write_bits(kind, out, range(n), bits, Q.read_bits(kind, block, range(n), bits)) == block


def test_linear_algebra():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))
    h = x.T @ x / 40
    low = L.cholesky(h)
    np.testing.assert_allclose(low @ low.T, h)
    inverse = np.linalg.inv(h)
    np.testing.assert_allclose(L.saliency(low), 1 / np.diag(inverse))
    np.testing.assert_allclose(L.inverse_column(low, 3), inverse[:, 3])
    with pytest.raises(ValueError, match="row 1"):
        L.cholesky(np.diag([1.0, -1.0]))
    f, pivots = L.pivoted_cholesky(h, 8)
    np.testing.assert_allclose(f @ f.T, h, atol=1e-9)
    assert sorted(pivots) == list(range(8))
    free, m = L.compensation(h, [2, 5])
    d = np.zeros(8)
    d[[2, 5]] = 0.3, -0.1
    d[free] = m @ d[[2, 5]]
    np.testing.assert_allclose((h @ d)[free], 0, atol=1e-12)  # no free channel can lower the error further
    with pytest.raises(ValueError):
        L.compensation(h, [1, 1])
    assert L.matrix_report(np.eye(4), 4, 4)["low_rank"] < 1e-12


def test_records():
    e = [("b", 0, 7), ("a", 1, 9)]
    raw = R.pack_directory(e)
    assert R.unpack_directory(raw) == sorted(e)
    for bad in (raw[:-1], raw + b"x"):
        with pytest.raises(ValueError):
            R.unpack_directory(bad)
    with pytest.raises(ValueError):
        R.pack_directory([("a", 0, 1), ("a", 0, 2)])
    m = R.pack_manifest(5, [bytes([i]) * 16 for i in range(6)])
    assert len(m) == 116 and R.unpack_manifest(m)[0] == 5
    with pytest.raises(ValueError, match="checksum"):
        R.unpack_manifest(m[:50] + b"\xff" + m[51:])


def test_decoder():
    rng = np.random.default_rng(1)
    d, f, v = 8, 16, 12
    w = {"token_embd": rng.normal(size=(v, d)), "output_norm": np.ones(d)}
    for i in range(2):
        for name, shape in (("attn_q", (d, d)), ("attn_k", (4, d)), ("attn_v", (4, d)), ("attn_output", (d, d)), ("ffn_gate", (f, d)), ("ffn_up", (f, d)), ("ffn_down", (d, f))):
            w[f"blk.{i}.{name}"] = rng.normal(size=shape) * 0.3
        w[f"blk.{i}.attn_norm"] = w[f"blk.{i}.ffn_norm"] = np.ones(d)
    m = Decoder(w, heads=2, kv_heads=1)
    t = np.array([1, 5, 3, 7, 2])
    whole = m.run(t)
    cache = []
    parts = np.concatenate([m.run(t[:2], cache), m.run(t[2:3], cache), m.run(t[3:], cache)])
    np.testing.assert_allclose(whole, parts, atol=1e-4)
    np.testing.assert_allclose(m.run(t, last_only=True)[0], whole[-1], atol=1e-5)
    seen = []
    m.run(t, observe=lambda site, layer, x: seen.append((site, layer, x.shape)))
    assert len(seen) == 8 and seen[3] == ("ffn_down_input", 0, (5, f))
    assert m.perplexity(t, 4) > 1
    with pytest.raises(ValueError):
        m.perplexity(t, 1)
