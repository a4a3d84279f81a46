"""Write buffers as an ordered fold of a log, and tool calls over the namespace."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(log: DataFrame) -> DataFrame:
    """(file, size, revision): what the folds of all writes come to; sets suffice for that."""
    return log.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("size"), F.count(F.lit(1)).alias("revision"))


def folded(log: DataFrame) -> DataFrame:
    """(file, size, revision, flushed, digest): every file's writes in order, zeros in gaps, flush at each
    event of type purchase. A file is the unit of order, files run in parallel."""
    import hashlib

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, revision, flushed = bytearray(), 0, 0
        for r in pdf.sort_values("seq").itertuples(index=False):
            end = int(r.offset) + int(r.length)
            if end > len(held):
                held.extend(bytes(end - len(held)))
            held[int(r.offset) : end] = bytes([int(r.seq) % 256]) * int(r.length)
            revision += 1
            if r.event_type == "purchase":
                flushed = revision
        return pd.DataFrame([(pdf["file"].iloc[0], len(held), revision, flushed, hashlib.sha256(bytes(held)).hexdigest())], columns=["file", "size", "revision", "flushed", "digest"])

    return log.groupBy("file").applyInPandas(run, "file long, size long, revision long, flushed long, digest string")


def last_writer(log: DataFrame, block: int = 16) -> DataFrame:
    """(file, block, seq): the last write that touches each block of a file."""
    x = log.select("file", "seq", F.explode(F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + length - 1) div {block}"))).alias("block"))
    return x.groupBy("file", "block").agg(F.max("seq").alias("seq"))
