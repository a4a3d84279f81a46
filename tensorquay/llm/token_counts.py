"""Token counts by overlap resynchronisation (operator 8).

The text's encoding is put together from parts that are encoded apart, joined only at places that are
proven to be boundaries of the whole text's encoding:

* A single space between two characters that are not white space always begins a pre-token (word
  classes take one leading space, and no class holds a space inside).  Ordinary texts fall apart
  there, equal parts are encoded once, and a bounded table remembers them.
* A huge text (over CHUNK characters) is encoded in overlapping chunks with offsets.  A chunk's boundary is trusted if enough text follows it in the chunk that nothing behind
  could move it; the next chunk is joined at the first trusted boundary of the former at which it has
  a boundary too (not its first one, which no text before it determines).  From there on both read the
  same text from the same state, so the rest agrees.  If the overlap has no such place it is widened,
  at last to the whole part.

Counts are those of the library over the whole text, with special strings taken as it takes them by
default, and no tokens added.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted one by one;
nothing is cut off; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_kernels import buffers, tidy

#: Characters of a chunk, and of the overlap at first.
CHUNK, OVERLAP = 32_768, 512
MEMO_PARTS = 400_000
MEMO_CHARS = 64
THREADS = 2
LIMIT = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Counter:
    """Counts tokens with one vocabulary; one for each worker."""

    _own: dict[str, Counter] = {}

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        from tokenizers.processors import ByteLevel as Offsets

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        # the splits at spaces are proven for byte-level pre-tokens without a normaliser only
        self.splits = isinstance(self.tok.pre_tokenizer, ByteLevel) and self.tok.normalizer is None and not self.tok.pre_tokenizer.add_prefix_space and not any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in self.tok.get_added_tokens_decoder().values())
        self.margin = 8 + max([0, *(len(t.content) for t in self.tok.get_added_tokens_decoder().values())])
        if self.splits:
            self.tok.post_processor = Offsets(trim_offsets=False)
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, int] = {}
        self.widened = 0

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(start of each pre-token, number of tokens before it, all tokens) of a chunk."""
        e = self.tok.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        start = np.array([o[0] for o in e.offsets], np.int64)
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (word[1:] < 0)
        at = np.flatnonzero(new)
        return start[at], at, len(word)

    def huge(self, text: str) -> int:
        """Tokens of a text of any length, by overlapping chunks joined at proven boundaries."""
        if not self.splits:
            return len(self.tok.encode(text, add_special_tokens=False))
        size, total, skip, overlap = len(text), 0, 0, self.overlap
        begin, joined, end = 0, 0, min(size, self.chunk)  # a chunk's start, its first proven boundary, its end
        start, before, tokens = self._chunk(text[:end])
        while end < size:
            # the last place after which enough text follows in this chunk to settle it
            safe = begin + len(text[begin : end - self.margin].rstrip()) - 1
            low = max(joined, end - self.margin - overlap)
            top = min(size, low + max(self.chunk, 4 * overlap))
            n_start, n_before, n_tokens = self._chunk(text[low:top])
            mine = {s + begin: n for s, n in zip(start.tolist(), before.tolist()) if low < s + begin <= safe}
            join = next(((s + low, n) for s, n in zip(n_start[1:].tolist(), n_before[1:].tolist()) if s + low in mine), None)
            if join is None:
                self.widened += 1
                if low == joined:  # no place in all of this chunk: a longer one from its proven boundary
                    begin, skip, end = joined, 0, min(size, joined + 4 * (end - joined))
                    start, before, tokens = self._chunk(text[begin:end])
                overlap *= 4
                continue
            joined = join[0]
            total += mine[joined] - skip
            begin, end, skip, overlap = low, top, join[1], self.overlap
            start, before, tokens = n_start, n_before, n_tokens
        return total + tokens - skip

    def parts(self, text: str) -> list[str]:
        """``text`` cut before single spaces between characters that are not white space."""
        if not self.splits:
            return [text]
        out, held = [], ""
        for i, p in enumerate(text.split(" ")):
            piece = " " + p if i else p
            if i and p and not p[0].isspace() and held and not held[-1].isspace():
                out.append(held)
                held = piece
            else:
                held += piece
        if held:
            out.append(held)
        return out

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.parts(t) if len(t) <= self.chunk else [t] for t in texts]
        new = {p for parts in cut for p in parts}.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_PARTS:
            self.memo.clear()
            new = {p for parts in cut for p in parts}
        short = [p for p in new if len(p) <= self.chunk]
        fresh = dict(zip(short, map(len, self.tok.encode_batch_fast(short, add_special_tokens=False)))) if short else {}
        fresh.update((p, self.huge(p)) for p in new if len(p) > self.chunk)
        self.memo.update((p, n) for p, n in fresh.items() if len(p) <= MEMO_CHARS)
        both = (self.memo | fresh) if len(fresh) > len(self.memo) else None
        if both is None:
            look = self.memo.get
            return [sum(n if (n := look(p)) is not None else fresh[p] for p in parts) for parts in cut]
        return [sum(map(both.__getitem__, parts)) for parts in cut]


def counted(docs: DataFrame, vocabulary: str | None = None, rows: int = 256) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of ``docs``."""
    path = vocabulary or default_vocabulary()
    x = docs.select("doc_id", "text")
    kind = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                _, o = buffers(part.column(1))
                n = counter.count([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(o)), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return x.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
