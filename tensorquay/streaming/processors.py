"""Keyed streaming operators: content chunks of byte streams, write buffers with flushes.

``transformWithStateInPandas`` keeps the state of each key in RocksDB; an event that ends the stream (or
a flush) sends out what is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.chunking import Chunker, Params

#: The state store that stateful processors need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class ChunkProcessor(StatefulProcessor):
    """(stream, seq, data, last) -> the chunks that are complete; at most one chunk's bytes are held."""

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "data binary, place long, start long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        data, place, start = self.held.get() if self.held.exists() else (b"", 0, 0)
        chunker, out, ended = Chunker(self.params, bytes(data)), [], False
        batch = pd.concat(list(rows)).sort_values("seq")

        def give(pieces: list[bytes]) -> None:
            nonlocal place, start
            for p in pieces:
                out.append((key[0], place, start, len(p), hashlib.sha256(p).hexdigest()[:32]))
                place, start = place + 1, start + len(p)

        for r in batch.itertuples(index=False):
            give(chunker.feed(bytes(r.data)))
            if r.last:
                give(chunker.finish())
                ended = True
        if ended:
            self.held.clear()
        else:
            self.held.update((chunker.held, place, start))
        yield pd.DataFrame(out, columns=["stream", "place", "start", "length", "digest"])

    def close(self) -> None:
        pass


def chunk_stream(pieces: DataFrame, params: Params = Params()) -> DataFrame:
    """Chunks of byte streams (stream, seq, data, last), the same as of the whole contents."""
    return pieces.groupBy("stream").transformWithStateInPandas(ChunkProcessor(params), "stream long, place long, start long, length long, digest string", "Append", "None")


class BufferProcessor(StatefulProcessor):
    """Writes (file, seq, offset, data, op) folded by file; a flush emits the size, digest and revision.

    A flush whose offset names an older revision than the buffer's leaves it dirty and emits nothing (0
    names none).  A released file leaves no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "data binary, revision long, flushed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        data, revision, flushed = self.buffer.get() if self.buffer.exists() else (b"", 0, 0)
        data, out = bytearray(data), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if r.op == "write":
                end = int(r.offset) + len(r.data)
                if end > len(data):
                    data.extend(bytes(end - len(data)))
                data[int(r.offset) : end] = bytes(r.data)
                revision += 1
            elif r.op == "truncate":
                data = data[: int(r.offset)] + bytes(max(0, int(r.offset) - len(data)))
                revision += 1
            elif r.op == "flush":
                if 0 < int(r.offset) < revision:
                    continue
                flushed = revision
                out.append((key[0], int(r.seq), len(data), revision, hashlib.sha256(bytes(data)).hexdigest()))
            elif r.op == "release":
                if flushed < revision:
                    out.append((key[0], int(r.seq), len(data), revision, hashlib.sha256(bytes(data)).hexdigest()))
                data, revision, flushed = bytearray(), 0, 0
        if revision or flushed or data:
            self.buffer.update((bytes(data), revision, flushed))
        else:
            self.buffer.clear()
        yield pd.DataFrame(out, columns=["file", "seq", "size", "revision", "digest"])

    def close(self) -> None:
        pass


def buffer_stream(log: DataFrame) -> DataFrame:
    return log.groupBy("file").transformWithStateInPandas(BufferProcessor(), "file long, seq long, size long, revision long, digest string", "Append", "None")
