"""Chunk tables, storing each content once, inode tiers and snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import Params, chunk_ends


def chunked(files: DataFrame, params: Params = Params()) -> DataFrame:
    """(path, place, start, length, digest, bytes): the content-defined chunks of files (path, content)."""
    x = files.select("path", F.col("content").cast("binary").alias("content"))
    x = x.withColumn("ends", chunk_ends("content", params)).withColumn("starts", F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0)))))
    x = x.select("path", "content", F.posexplode(F.arrays_zip("starts", "ends")).alias("place", "x")).where("x.ends is not null")
    piece = F.expr("substring(content, x.starts + 1, x.ends - x.starts)")
    return x.select("path", "place", F.col("x.starts").alias("start"), (F.col("x.ends") - F.col("x.starts")).alias("length"), F.substring(F.sha2(piece, 256), 1, 32).alias("digest"), piece.alias("bytes"))


def stored(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """The chunks that must be written: one row for each digest not yet known."""
    return chunks.join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])


def outcomes(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Each chunk with was_new: its digest was not known before."""
    k = known.select(F.col("digest").alias("k_digest")).distinct()
    return chunks.join(k, F.col("digest") == F.col("k_digest"), "left").withColumn("was_new", F.col("k_digest").isNull()).drop("k_digest")


def index(chunks: DataFrame) -> DataFrame:
    """digest -> the last place that holds it, in the order of (path, place)."""
    return chunks.groupBy("digest").agg(F.max(F.struct("path", "place")).alias("at"), F.count(F.lit(1)).alias("uses")).select("digest", "at.path", "at.place", "uses")


def loaded(chunks: DataFrame) -> DataFrame:
    """(path, content): files put together from their chunks in order."""
    pieces = F.array_sort(F.collect_list(F.struct("place", "bytes")))
    return chunks.groupBy("path").agg(F.aggregate(F.transform(pieces, lambda p: p["bytes"]), F.unhex(F.lit("")), lambda a, b: F.concat(a, b)).alias("content"))


#: Pointers in an inode itself, and in a block of pointers.
DIRECT, PER_BLOCK = 12, 256


def inode_tier(place: str = "place") -> tuple:
    """(tier, block): whether a chunk hangs on the inode, or below one, two or three levels of blocks."""
    n = F.col(place) - DIRECT
    two, three = PER_BLOCK, PER_BLOCK + PER_BLOCK**2
    tier = F.when(F.col(place) < DIRECT, "direct").when(n < two, "single").when(n < three, "double").otherwise("triple")
    block = F.when(F.col(place) < DIRECT, 0).when(n < two, 0).when(n < three, F.floor((n - two) / PER_BLOCK)).otherwise(F.floor((n - three) / PER_BLOCK))
    return tier.alias("tier"), block.cast("long").alias("block")


class Snapshots:
    """Generations of tables under one folder, published by manifests whose checksum must hold.

    A commit writes new tables, then its manifest; a reader takes the highest generation whose manifest
    is valid.  Each generation's manifest has a name of its own that only one writer can create, so of two
    writers one fails; the former manifest is there until the next commit.  A manifest that a crash cut
    short keeps its name taken until it is removed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def manifests(self) -> list[dict]:
        """The valid manifests, newest first."""
        fs, path = self._fs()
        at = path(f"{self.folder}/manifests")
        if not fs.exists(at):
            return []
        rows = self.spark.read.text(f"{self.folder}/manifests/*.json", wholetext=True).select("value", F.crc32(F.substring_index("value", "\n", 1)).alias("crc")).collect()
        found = []
        for r in rows:
            body, _, crc = r["value"].partition("\n")
            try:
                if int(crc) == r["crc"]:
                    found.append(json.loads(body))
            except ValueError:
                continue
        return sorted(found, key=lambda m: -m["generation"])

    def commit(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write the tables as the next generation; ``expected`` is the generation that must be current."""
        current = next((m["generation"] for m in self.manifests()), 0)
        if expected is not None and expected != current:
            raise RuntimeError(f"generation {current} is current, not {expected}")
        generation = current + 1
        names = {}
        for name, df in tables.items():
            names[name] = f"gen={generation}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{names[name]}")
        body = json.dumps({"generation": generation, "tables": names}, sort_keys=True)
        crc = self.spark.range(1).select(F.crc32(F.lit(body)).alias("c")).first()["c"]
        fs, path = self._fs()
        final = path(f"{self.folder}/manifests/{generation}.json")
        fs.mkdirs(final.getParent())
        try:
            out = fs.create(final, False)  # never over another writer's
        except Exception as e:
            raise RuntimeError(f"generation {generation} has another writer") from e
        out.write(bytearray(f"{body}\n{crc}".encode()))
        out.close()
        fs.delete(path(f"{self.folder}/manifests/{generation - 2}.json"), False)
        return generation

    def read(self, name: str) -> DataFrame:
        newest = self.manifests()
        if not newest:
            raise RuntimeError("there is no valid manifest")
        return self.spark.read.parquet(f"{self.folder}/{newest[0]['tables'][name]}")
