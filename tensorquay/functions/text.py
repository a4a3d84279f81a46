"""Pre-tokens and byte-pair merges."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second pass of the pre-token split: contractions, letters, numbers or other marks with one leading
#: space, white space (fixed value; Unicode classes).
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s"


def pre_tokens(text: Column) -> Column:
    """Single digits apart, then words; every character is in one piece."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)\p{N}|\P{N}+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(WORDS), F.lit(0))))


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: printable ones stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder of a byte-level vocabulary (token -> id) with ranked merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], begin: int | None = None, end: int | None = None):
        self.ids, self.begin, self.end = vocabulary, begin, end
        self.rank = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.letter = byte_letters()
        self.byte = {c: b for b, c in self.letter.items()}
        self.token = {i: t for t, i in vocabulary.items()}
        self.pieces = lru_cache(100_000)(self._pieces)

    def _pieces(self, word: str) -> tuple[str, ...]:
        parts = [self.letter[b] for b in word.encode()]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return tuple(parts)

    def encode(self, words: list[str], add_begin: bool = False, add_end: bool = False) -> list[int]:
        out = [self.begin] if add_begin and self.begin is not None else []
        for w in words:
            for p in self.pieces(w):
                if p not in self.ids:
                    raise KeyError(f"{p!r} is not in the vocabulary")
                out.append(self.ids[p])
        return out + ([self.end] if add_end and self.end is not None else [])

    def decode(self, ids: list[int]) -> str:
        kept = [self.token[i] for i in ids if i not in (self.begin, self.end)]
        return bytes(self.byte[c] for t in kept for c in t).decode("utf-8")


def from_tokenizer_json(path: str) -> BytePairs:
    """A vocabulary and its merges from a tokenizer's JSON file."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return BytePairs(model["vocab"], merges)


_cached: dict[str, BytePairs] = {}


def encoded(pieces: str | Column, path: str) -> Column:
    """Token ids of a column of pre-tokens (array of string); an Arrow UDF with one encoder a worker."""

    @F.pandas_udf("array<int>")
    def run(words: pd.Series) -> pd.Series:
        if path not in _cached:
            _cached[path] = from_tokenizer_json(path)
        return pd.Series([None if w is None else _cached[path].encode(list(w)) for w in words])

    return run(pieces)


def decoded(ids: str | Column, path: str) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        if path not in _cached:
            _cached[path] = from_tokenizer_json(path)
        return pd.Series([None if r is None else _cached[path].decode([int(i) for i in r]) for r in rows])

    return run(ids)
