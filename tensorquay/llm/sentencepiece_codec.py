"""SentencePiece encoding and decoding on the tokenizers library (operator 1).

The model's protobuf is read here, field by field; from it the normaliser, the marker that stands for
a space, the pieces with their scores (unigram) or merges (BPE) and the byte fallback are rebuilt as a
``tokenizers.Tokenizer``.  If no piece goes on past a marker that follows another character, a text
falls apart into units before each such marker, and its ids are its units' ids.  Batches of units are
encoded by the library's threads; a bounded table keeps units already met.  Parity is verified for
every unit on its first encoding (the reference encoder gets the same units); where the two differ,
its ids are kept and the unit counted, so the ids are always those of the model.

Defined cases: a null text has null ids and 0 tokens, an empty text no ids; repeated rows are encoded one by one
with the same ids; texts are encoded whole; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_kernels import tidy

#: Units whose ids a worker remembers, in a table and the one before it.
MEMO_UNITS = 200_000
#: Longer units are not remembered.
MEMO_CHARS = 64
#: Threads of the library in a worker.
THREADS = 2
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def fields(raw: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of each field of a protobuf message; embedded messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """What a SentencePiece model file says: pieces (text, score, type) and the normaliser's settings."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_id = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.strip_spaces, self.escape = b"", True, True, True
        for number, value in fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
                    elif n == 40:
                        self.unk_id = v
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.strip_spaces = bool(v)
                    elif n == 5:
                        self.escape = bool(v)

    @property
    def separable(self) -> bool:
        """No piece holds a marker after another character, so units can be encoded apart."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs whose join is a piece, best piece first."""
        known = {p for p, _, kind in self.pieces if kind in (NORMAL, UNUSED)}
        ranked = sorted(((-score, i, p) for i, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, UNUSED) and len(p) > 1))
        return [(p[:j], p[j:]) for _, _, p in ranked for j in range(1, len(p)) if p[:j] in known and p[j:] in known]

    def tokenizer(self, prefix: bool = True):
        """The library's tokenizer; ``prefix``: it normalises and adds the leading marker itself."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        unk = self.pieces[self.unk_id][0]
        if self.kind == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        out = Tokenizer(model)
        if prefix:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            if self.strip_spaces:
                steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
            if self.dummy_prefix:
                steps.append(normalizers.Prepend(" "))
            if self.escape:
                steps.append(normalizers.Replace(" ", MARK))
            out.normalizer = normalizers.Sequence(steps)
        out.add_tokens([AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER])
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return out


class Codec:
    """Encodes and decodes batches; one for each worker and model."""

    _own: dict[str, Codec] = {}
    _unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, path: str, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        # units are cut after normalisation, so both encoders must see plain pieces of text
        self.by_unit = self.model.separable and not self.model.charsmap and not self.model.strip_spaces and self.model.escape
        self.tok = self.model.tokenizer(prefix=not self.by_unit)
        # units without their first marker -> ids, four bytes each; the former table serves until it is full again
        self.memo: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}  # units that do not decode to themselves
        self.odd: set[str] = set()  # units that the rebuilt encoder cuts otherwise

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _reference_ids(self, units: list[str]) -> list[list[int] | None]:
        """The reference encoder's ids of each unit that it can be asked for, else None."""
        if not self.by_unit:
            return self.reference.encode(units, num_threads=self.threads)
        drop = 1 if self.model.dummy_prefix else 0
        # a lone marker can't be asked for: the reference adds none to an empty text
        comparable = [u.startswith(MARK) and u != MARK if drop else True for u in units]
        marked = [u[drop:].replace(MARK, " ") for u, c in zip(units, comparable) if c]
        ids = iter(self.reference.encode(marked, num_threads=self.threads) if marked else [])
        return [next(ids) if c else None for c in comparable]

    @property
    def _lead(self) -> str:
        return MARK if self.by_unit and self.model.dummy_prefix else ""

    def cut(self, text: str) -> list[str]:
        """The units of a text, each without its first marker if the model puts one before a text."""
        if not text:
            return []
        if not self.by_unit:
            return [text]
        if self._lead and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        units = self._unit.findall(self._lead + text.replace(" ", MARK))
        return [u[1:] for u in units] if self._lead else units

    def _learn(self, keys: list[str], parity: bool) -> None:
        units = [self._lead + k for k in keys] if self._lead else keys
        got = [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]
        if parity:
            for i, ids in enumerate(self._reference_ids(units)):
                if ids is not None and ids != got[i]:
                    self.odd.add(keys[i])
                    got[i] = ids
        texts = self.tok.decode_batch(got, skip_special_tokens=False)
        for key, unit, text, ids in zip(keys, units, texts, got):
            if text != self._plain(unit):
                self.texts[key] = text
            self.memo[key] = array("i", ids).tobytes()

    def _plain(self, unit: str) -> str:
        return unit.replace(MARK, " ") if self.by_unit else unit

    def encode(self, texts: list[str | None], parity: bool = True) -> tuple[list[np.ndarray | None], list[str | None], list[int]]:
        """ids, decoded text, and number of units in which the encoders differed, of each text."""
        cut = [None if t is None else self.cut(t) for t in texts]
        keys = set(chain.from_iterable(x for x in cut if x))
        new = keys.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_UNITS:
            self.former, self.memo = self.memo, {}
            self.texts, self.odd, new = {k: v for k, v in self.texts.items() if k in self.former}, {k for k in self.odd if k in self.former}, keys
        known = new & self.former.keys()
        self.memo.update((k, self.former[k]) for k in known)
        if unknown := list(new - known):
            self._learn(unknown, parity)
        ids, decoded, odd = [], [], []
        for units in cut:
            if units is None:
                ids.append(None)
                decoded.append(None)
                odd.append(0)
                continue
            ids.append(np.frombuffer(b"".join(map(self.memo.__getitem__, units)), np.int32))
            if self.texts and not self.texts.keys().isdisjoint(units):
                text = "".join([self.texts[u] if u in self.texts else self._plain(self._lead + u) for u in units])
            else:
                text = self._plain((self._lead + self._lead.join(units)) if units else "")
            decoded.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
            odd.append(sum(u in self.odd for u in units) if self.odd else 0)
        for k in [k for k in keys if len(k) > MEMO_CHARS]:
            del self.memo[k]
        return ids, decoded, odd

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        texts = iter(self.tok.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
        out = []
        for x in ids:
            text = None if x is None else next(texts)
            out.append(text[1:] if text and self.model.dummy_prefix and text.startswith(" ") else text)
        return out


def encoded(df: DataFrame, model: str | None = None, rows: int = 256, digest: bool = False) -> DataFrame:
    """``df`` with n_tokens, ids, round_trip (decoding gives the text back) and parity_misses; with
    ``digest`` also decoded_sha256."""
    path = model or default_model()
    extra = [("n_tokens", pa.int64(), "long"), ("ids", pa.list_(pa.int32()), "array<int>"), ("round_trip", pa.bool_(), "boolean"), ("parity_misses", pa.int64(), "long")]
    if digest:
        extra.append(("decoded_sha256", pa.string(), "string"))
    names = [c for c in df.columns if c not in {n for n, _, _ in extra}]  # a column of the result replaces the input's
    inner = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    at = names.index("text")
    schema = ", ".join([*(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), *(f"x_{n} {t}" for n, _, t in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                texts = part.column(at).to_pylist()
                ids, decoded, odd = codec.encode(texts)
                offs = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None and len(x)] or [np.zeros(0, np.int32)])
                mask = pa.array([x is None for x in ids])
                more = [pa.array([0 if x is None else len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat), mask=mask), pa.array([d == t for d, t in zip(decoded, texts)], pa.bool_()), pa.array(odd, pa.int64())]
                if digest:
                    more.append(pa.array([None if d is None else hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *(f"x_{n}" for n, _, _ in extra)])

    out = inner.mapInArrow(tidy(run), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *(F.col(f"x_{n}").alias(n) for n, _, _ in extra))


def decoded(df: DataFrame, model: str | None = None) -> DataFrame:
    """``df`` (with a column ids) with a column decoded."""
    path = model or default_model()
    df = df.drop("decoded")  # the result's column replaces the input's
    names = df.columns
    at = names.index("ids")
    inner = df.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join([*(f"{c} {inner.schema[c].dataType.simpleString()}" for c in inner.columns), "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            texts = codec.decode(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return inner.mapInArrow(tidy(run), schema).toDF(*names, "decoded")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, digest=True).drop("text")
