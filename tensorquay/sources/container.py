"""Quantised weight containers (GGUF, versions 2 and 3): reader, writer, and tables for Spark.

A container is a header, typed key-value pairs, tensor descriptors, padding to the alignment, and the
tensors' bytes.  Headers are small and decode in one row; tensor bytes are read block range by block
range, so a large file spreads over many tasks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bits import QUANT_TYPES
from ..functions.quant import BLOCK_BYTES, DECODERS, dequantized

MAGIC, VERSIONS, DEFAULT_ALIGNMENT = b"GGUF", (2, 3), 32
#: Value type ids (fixed values of the format).
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9
BLOCK_WEIGHTS = {name: weights for name, _, weights, _ in QUANT_TYPES.values()}


class ContainerError(ValueError):
    pass


@dataclass
class Tensor:
    name: str
    dimensions: list[int]
    raw_type: int
    offset: int

    @property
    def weights(self) -> int:
        n = 1
        for d in self.dimensions:
            n *= d
        return n

    @property
    def type_name(self) -> str | None:
        return QUANT_TYPES[self.raw_type][0] if self.raw_type in QUANT_TYPES else None

    @property
    def size(self) -> int | None:
        if self.type_name is None:
            return None
        return -(-self.weights // BLOCK_WEIGHTS[self.type_name]) * BLOCK_BYTES[self.type_name]


@dataclass
class Container:
    version: int
    alignment: int
    data_offset: int
    pairs: list[tuple[str, int, Any]] = field(default_factory=list)
    tensors: list[Tensor] = field(default_factory=list)

    def value(self, key: str, default: Any = None) -> Any:
        """The first value of a key."""
        return next((v for k, _, v in self.pairs if k == key), default)


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ContainerError(f"the file ends within {n} bytes at {self.at}")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, form: str) -> Any:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def string(self) -> str:
        return self.take(self.number("<Q")).decode("utf-8")

    def value(self, kind: int) -> Any:
        if kind in SCALARS:
            return bool(self.number("<B")) if kind == 7 else self.number(SCALARS[kind])
        if kind == STRING:
            return self.string()
        if kind == ARRAY:
            inner, n = self.number("<I"), self.number("<Q")
            return [self.value(inner) for _ in range(n)]
        raise ContainerError(f"unknown value type {kind}")


def parse(raw: bytes) -> Container:
    """The header of a container; an error for bad magic, version, alignment or a cut file."""
    c = _Cursor(raw)
    if c.take(4) != MAGIC:
        raise ContainerError("bad magic")
    version = c.number("<I")
    if version not in VERSIONS:
        raise ContainerError(f"unsupported version {version}")
    n_tensors, n_pairs = c.number("<Q"), c.number("<Q")
    pairs = []
    for _ in range(n_pairs):
        key, kind = c.string(), c.number("<I")
        pairs.append((key, kind, c.value(kind)))
    tensors = []
    for _ in range(n_tensors):
        name, rank = c.string(), c.number("<I")
        dims = [c.number("<Q") for _ in range(rank)]
        tensors.append(Tensor(name, dims, c.number("<I"), c.number("<Q")))
    align = next((v for k, _, v in pairs if k == "general.alignment"), DEFAULT_ALIGNMENT)
    if not align:
        raise ContainerError("the alignment is zero")
    return Container(version, align, -(-c.at // align) * align, pairs, tensors)


def build(pairs: list[tuple[str, int, Any]], tensors: list[tuple[str, list[int], int, bytes]], version: int = 3) -> bytes:
    """A container's bytes, for fixtures and exports."""
    align = next((v for k, _, v in pairs if k == "general.alignment"), DEFAULT_ALIGNMENT)

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<Q", len(raw)) + raw

    def value(kind: int, v: Any) -> bytes:
        if kind == STRING:
            return text(v)
        if kind == ARRAY:
            inner, items = v
            return struct.pack("<IQ", inner, len(items)) + b"".join(value(inner, x) for x in items)
        return struct.pack(SCALARS[kind], v)

    head = MAGIC + struct.pack("<IQQ", version, len(tensors), len(pairs))
    head += b"".join(text(k) + struct.pack("<I", kind) + value(kind, v) for k, kind, v in pairs)
    at, bodies = 0, []
    for name, dims, kind, raw in tensors:
        head += text(name) + struct.pack("<I", len(dims)) + struct.pack(f"<{len(dims)}Q", *dims) + struct.pack("<IQ", kind, at)
        body = raw + bytes(-len(raw) % align)
        bodies.append(body)
        at += len(body)
    return head + bytes(-len(head) % align) + b"".join(bodies)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The headers of every file under ``path``."""
    return headers_of(host_files(spark, path))


def headers_of(files: DataFrame) -> DataFrame:
    """(path, version, alignment, data_offset, error, pairs, tensors) of each file (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, raw in zip(pdf["path"], pdf["content"]):
                try:
                    c = parse(bytes(raw))
                    out.append((file, c.version, c.alignment, c.data_offset, None, [(k, t, json.dumps(v)) for k, t, v in c.pairs], [(t.name, t.dimensions, t.raw_type, t.offset) for t in c.tensors]))
                except (ContainerError, UnicodeDecodeError) as e:
                    out.append((file, None, None, None, str(e), [], []))
            yield pd.DataFrame(out, columns=["path", "version", "alignment", "data_offset", "error", "pairs", "tensors"]).astype({"version": "Int32", "alignment": "Int64", "data_offset": "Int64"})

    schema = "path string, version int, alignment long, data_offset long, error string, pairs array<struct<key:string,type:int,value:string>>, tensors array<struct<name:string,dimensions:array<bigint>,raw_type:int,data_offset:bigint>>"
    return files.select("path", "content").mapInPandas(run, schema)


def pairs(header: DataFrame) -> DataFrame:
    """(path, place, key, type, value): values as JSON text."""
    return header.select("path", F.posexplode("pairs").alias("place", "p")).select("path", "place", "p.*")


def pair_value(kv: DataFrame, key: str) -> DataFrame:
    """The first value of a key in each file."""
    return kv.where(F.col("key") == key).groupBy("path").agg(F.min_by("value", "place").alias("value"))


def tokenizer_pairs(kv: DataFrame) -> DataFrame:
    return kv.where(F.col("key").startswith("tokenizer.ggml"))


def tensors(header: DataFrame) -> DataFrame:
    """(path, name, dimensions, raw_type, data_offset): offsets from the file's start."""
    x = header.select("path", F.col("data_offset").alias("base"), F.explode("tensors").alias("t"))
    return x.select("path", "t.name", "t.dimensions", "t.raw_type", (F.col("base") + F.col("t.data_offset")).alias("data_offset"))


def model_config(kv: DataFrame) -> DataFrame:
    """One row for each file: sizes and constants of a llama-like model, with the usual defaults."""
    number = lambda k: F.max(F.when(F.col("key") == f"llama.{k}", F.col("value").cast("double")))
    x = kv.groupBy("path").agg(
        F.max(F.when(F.col("key") == "general.architecture", F.col("value"))).alias("architecture"),
        number("block_count").alias("layers"),
        number("embedding_length").alias("width"),
        number("attention.head_count").alias("heads"),
        number("attention.head_count_kv").alias("kv_heads"),
        number("rope.dimension_count").alias("rope_width"),
        number("rope.freq_base").alias("rope_base"),
        number("attention.layer_norm_rms_epsilon").alias("epsilon"),
        number("context_length").alias("context"),
    )
    whole = lambda c: F.col(c).cast("int")
    return x.where(F.col("architecture") == '"llama"').select(
        "path",
        whole("layers").alias("layers"),
        whole("width").alias("width"),
        whole("heads").alias("heads"),
        F.coalesce(whole("kv_heads"), whole("heads")).alias("kv_heads"),
        F.coalesce(whole("rope_width"), (whole("width") / whole("heads")).cast("int")).alias("rope_width"),
        F.coalesce("rope_base", F.lit(10_000.0)).alias("rope_base"),
        F.coalesce("epsilon", F.lit(1e-5)).alias("epsilon"),
        F.coalesce(whole("context"), F.lit(0)).alias("context"),
    )


def vocabulary(kv: DataFrame) -> DataFrame:
    """(path, id, token, type): an error if tokens and types differ in number."""
    lists = kv.groupBy("path").agg(F.max(F.when(F.col("key") == "tokenizer.ggml.tokens", F.col("value"))).alias("tokens"), F.max(F.when(F.col("key") == "tokenizer.ggml.token_type", F.col("value"))).alias("types"))
    x = lists.select("path", F.from_json("tokens", "array<string>").alias("tokens"), F.from_json("types", "array<int>").alias("types"))
    checked = F.when(F.size("tokens") == F.size("types"), F.arrays_zip("tokens", "types")).otherwise(F.raise_error(F.lit("tokens and types differ in number")))
    return x.select("path", F.posexplode(checked).alias("id", "t")).select("path", "id", F.col("t.tokens").alias("token"), F.col("t.types").alias("type"))


def merges(kv: DataFrame) -> DataFrame:
    """(path, rank, left, right): a merge's parts are split at the first space."""
    x = pair_value(kv, "tokenizer.ggml.merges").select("path", F.posexplode(F.from_json("value", "array<string>")).alias("rank", "m"))
    return x.select("path", "rank", F.substring_index("m", " ", 1).alias("left"), F.expr("substring(m, instr(m, ' ') + 1)").alias("right"))


def decoded_tensors(files: DataFrame, header: DataFrame) -> DataFrame:
    """(path, name, type, weights): whole tensors of small files (path, content), decoded."""
    from ..functions.bits import type_name
    from ..functions.quant import dequantize

    t = tensors(header).withColumn("type", type_name(F.col("raw_type")))
    sizes = F.create_map(*(F.lit(x) for n in DECODERS for x in (n, BLOCK_BYTES[n])))
    per = F.create_map(*(F.lit(x) for n in DECODERS for x in (n, BLOCK_WEIGHTS[n])))
    count = F.aggregate("dimensions", F.lit(1).cast("long"), lambda a, x: a * x)
    x = t.withColumn("size", (F.ceil(count / per[F.col("type")]) * sizes[F.col("type")]).cast("int")).where("size is not null")
    raw = F.expr("substring(content, cast(data_offset + 1 as int), size)")
    return x.join(files, "path").select("path", "name", "type", dequantize(F.col("type"), raw).alias("weights"))


class BlockRange(InputPartition):
    def __init__(self, path: str, tensor: str, kind: str, offset: int, first: int, count: int):
        super().__init__((path, tensor, first))
        self.path, self.tensor, self.kind, self.offset, self.first, self.count = path, tensor, kind, offset, first, count


class _Blocks(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.per_split = int(options.get("blocksPerSplit", 1 << 16))
        self.names = [n for n in options.get("tensors", "").split(",") if n]

    def partitions(self) -> list[BlockRange]:
        with open(self.path, "rb") as f:
            head = parse(f.read(int(64 << 20)))
        out = []
        for t in head.tensors:
            if t.type_name not in DECODERS or self.names and t.name not in self.names:
                continue
            blocks = t.size // BLOCK_BYTES[t.type_name]
            out += [BlockRange(self.path, t.name, t.type_name, head.data_offset + t.offset, a, min(self.per_split, blocks - a)) for a in range(0, blocks, self.per_split)]
        return out

    def read(self, split: BlockRange) -> Iterator[tuple]:
        size, n = BLOCK_BYTES[split.kind], BLOCK_WEIGHTS[split.kind]
        with open(split.path, "rb") as f:
            f.seek(split.offset + split.first * size)
            for a in range(0, split.count, 4096):
                count = min(4096, split.count - a)
                values = dequantized(split.kind, f.read(count * size)).reshape(count, n)
                for i, row in enumerate(values):
                    yield split.tensor, split.kind, split.first + a + i, row.tolist()


class WeightBlocks(DataSource):
    """``spark.read.format("weight_blocks").load(path)``: one row for each block of each tensor, decoded.

    Splits are ranges of blocks; a file must be on a path that all executors can open (for object stores
    read with ``binaryFile`` and ``headers``). Options: tensors (names), blocksPerSplit.
    """

    @classmethod
    def name(cls) -> str:
        return "weight_blocks"

    def schema(self) -> str:
        return "tensor string, type string, block long, weights array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Blocks(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WeightBlocks)


def host_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole files as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def dumped_triangle(raw: bytes, n: int) -> np.ndarray:
    """A symmetric matrix from little-endian single-precision upper-triangle bytes."""
    from ..functions.linalg import unpacked_upper

    return unpacked_upper(np.frombuffer(raw, "<f4").astype(np.float64), n)
