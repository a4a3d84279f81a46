"""N-gram Jaccard join (operator 3): near-duplicate classes of documents, exactly.

A document's set holds its distinct ``k``-word shingles (A-Z lower-cased; 64-bit hashes).  Two
documents link when ``100 * |A and B| >= pct * |A or B|``.

1. Equal sets become one class (a partial aggregate on a 128-bit digest), so copies are compared once.
2. Sizes fall into bands whose ends differ by the threshold; a pair that links lies in one band or
   two neighbours.  Each class cuts the hash space into parts, for its own band and as a guest of the
   next, and has a key for every part: what the part holds.  For band ``i`` at most D shingles may
   differ, so of D + 1 + m parts m + 1 are equal in both sets, and of two sets that link, one with at
   most m empty parts is enough for a common key.  Large sets have fewer parts than that and no key for
   a part with a single shingle (which texts share by accident): the differing shingles fall on parts
   by their hashes, and a cut only counts for a set if they spare none of its parts with a chance below
   2^-60, less than that of two shingles with one hash.  A class for which a cut does not count has the
   keys of another cut as well (or, for tiny sets, one key for all such classes of the band).  The first
   cut leaves out the most frequent shingles (a bounded summary over all documents; leaving the same
   shingles out of all sets adds no difference), so a passage that many documents share brings none of
   them together.  Keys travel in binary rows by bucket, from each task once for all copies of a class.
3. Classes that share a key make clusters (contracted stars, never pairs of a group).  A small cluster is
   compared in one tile.  In a large one every class first meets pivots, one for each band of sizes, in
   tiles of their own; classes joined by pivots need no further comparison with each other, so only
   those outside the cluster's largest group go on, in blocks against all blocks of the same band and
   its neighbours.  First hashed bitmap signatures alone: the bits in which two differ bound the overlap
   from above; pairs within the bound make smaller clusters.  In these the texts come together in tiles,
   and pairs within the bound that are not yet connected get the exact intersection of their sorted arrays.
4. Links are contracted to components.

Defined cases: a null, empty or white-space text has the empty set, size 0, and links with nothing;
fewer words than ``k`` make one shingle; texts are read whole, however long; repeated rows and ties are
copies of one class; rows whose doc_id is null take part, and a component's id is its smallest doc_id
that is not null (null if there is none); an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, written
from .text_kernels import U, buffers, mix, seeds, shingle_sets, slices, tidy

#: Classes (signatures) or shingles (texts) of a block: of a cluster's pivot tiles, and the most of others.
TILE_CLASSES, MOST_CLASSES = 128, 4096
TILE_SHINGLES, MOST_SHINGLES = 64_000, 2_000_000
#: Blocks of a band below which blocks stay as small as those of pivot tiles, and the most of a pivot's tiles.
FEW_BLOCKS, MOST_BLOCKS = 16, 1 << 16
#: Times that a large cluster's classes meet pivots.
PIVOT_ROUNDS = 2
#: Bits of the filter that spares the shuffle of texts that need no comparison; a fixed 2 MB.
FILTER_BITS = 1 << 24
#: Keys that a task gathers before it hands them out, and classes it remembers to skip their copies.
FLUSH_KEYS, SEEN_CLASSES = 1_000_000, 100_000
#: Shingles for each bucket of keys, least number of buckets, and slices in which a task sorts a bucket.  A pair
#: is named once in each bucket in which it shares a key, so buckets are few, and each is a task.
BUCKET_SHINGLES, LEAST_BUCKETS, BUCKET_SLICES = 6_000_000, 16, 4
#: Shingles that the first cut leaves out: so many at most, in so many classes at least.
HOT, HOT_LEAST = 1 << 16, 48
#: Cuts tried before a set falls back to one key for its band (tiny sets, or thresholds well below 0.75).
MOST_CUTS = 24
#: Spared parts to expect before a cut counts: exp(-42) is below 2^-60.
SPARED = 42
_SEED = seeds(256, 9000)


class Bands:
    """Size bands, and for each the number of parts and when a cut counts.

    ``least`` is 1 where differing shingles cannot reach all parts (at most ``spare`` may be empty), and 2
    where there are fewer parts and the expected number of spared ones decides.
    """

    def __init__(self, pct: int, largest: int):
        self.pct = pct
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * 100 // pct + 1)
        self.low = np.array([*low, low[-1] * 100 // pct + 1], np.int64)
        top = self.low[1:] - 1
        self.most = (100 - pct) * 2 * top // (100 + pct)  # shingles in which two sets of a band can differ
        self.spare = np.zeros_like(self.most)
        self.least = np.ones_like(self.most)
        self.parts = self.most + 1
        for i, (d, least) in enumerate(zip(self.most.tolist(), [1, *self.low.tolist()])):
            m = 0
            while d:
                empty = (d + 1 + m) * np.exp(-0.75 * least / (d + 1 + m))  # a quarter may be left out as frequent
                if m >= empty + 2 * np.sqrt(empty) or m >= d:
                    break
                m += 1 + m // 16
            self.spare[i], self.parts[i] = m, d + 1 + m
            parts = max(SPARED, d // 8)
            while parts <= self.parts[i]:
                if min(self._expected(least, parts), self._expected(int(top[i]), parts)) >= 1.1 * SPARED:
                    self.parts[i], self.least[i] = parts, 2
                    break
                parts += 1 + parts // 32

    def _expected(self, n: int, parts: int) -> float:
        """Spared parts to expect for a set of ``n`` shingles."""
        k = np.arange(2, 200)
        chance = np.exp(k * math.log(n / parts) - n / parts - np.cumsum(np.log(k)))  # of k shingles in a part
        return float(parts * (chance * self.spared(k, n / parts)).sum())

    def spared(self, k: np.ndarray, share: np.ndarray | float) -> np.ndarray:
        """At least the chance that no difference falls on a part of ``k`` shingles, where parts hold ``share``.

        Another set has at most 1 - t of these shingles fewer or 1 / t - 1 more (t the threshold), or a
        mixture of both, which is never worse than the worse of the two.
        """
        t = self.pct / 100
        return np.exp(-np.maximum(k * math.log(1 / t), share * (1 / t - 1)))

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


@lru_cache(maxsize=64)
def bands_to(pct: int, doublings: int) -> Bands:
    """The bands of sizes below ``2 ** doublings`` and of their partners."""
    return Bands(pct, (1 << doublings) * 100 // pct + 1)


def part_keys(sets: list[np.ndarray], pct: int, hot: np.ndarray | None = None) -> list[np.ndarray]:
    """For each set the keys it shares, at least one, with every set that it links to (but equal ones).

    ``hot`` flags the 24-bit beginnings of shingles that the first cut leaves out.
    """
    out: list[list[np.ndarray]] = [[] for _ in sets]
    size = np.array([len(s) for s in sets], np.int64)
    if not len(size) or not size.max():
        return [np.zeros(0, U) for _ in sets]
    bands = bands_to(pct, int(size.max()).bit_length())
    home = np.where(size > 0, bands.of(size), 0)
    values = np.concatenate(sets)
    content = mix(values ^ _SEED[255])
    start = np.concatenate([[0], np.cumsum(size)])
    if hot is None:
        rare, r_size, r_start = None, size, start
    else:
        rare = np.flatnonzero(~hot[values >> U(40)])
        r_start = np.searchsorted(rare, start)
        r_size = np.diff(r_start)
    for guest in (0, 1):
        band = home + guest
        todo = np.flatnonzero((size > 0) & (bands.most[band] > 0))
        if guest:  # only if a partner can be that large
            todo = todo[size[todo] * 100 // pct >= bands.low[band[todo]]]
        for cut in range(MOST_CUTS):
            if not len(todo):
                break
            first_cut = cut == 0 and rare is not None
            n, begin = (r_size[todo], r_start[todo]) if first_cut else (size[todo], start[todo])
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            if first_cut:
                at = rare[at]
            parts = bands.parts[band[todo]]
            base = np.concatenate([[0], np.cumsum(parts)])
            part = ((mix(values[at] + _SEED[cut]) >> U(32)) * np.repeat(parts, n).astype(U)) >> U(32)
            slot = np.repeat(base[:-1], n) + part.astype(np.int64)
            full = np.bincount(slot, minlength=base[-1])
            total = np.zeros(base[-1], U)
            np.add.at(total, slot, content[at])
            where = np.arange(base[-1], dtype=np.int64) - np.repeat(base[:-1], parts)
            label = mix(where.astype(U) + (np.repeat(band[todo], parts).astype(U) << U(40)) + (U(cut) << U(56)))
            keys = mix(total + label + full.astype(U))
            strong = full >= np.repeat(bands.least[band[todo]], parts)
            empty = np.add.reduceat((full == 0).astype(np.int64), base[:-1])
            spared = np.add.reduceat(np.where(strong, bands.spared(full, np.repeat(size[todo] / parts, parts)), 0.0), base[:-1])
            for j, d in enumerate(todo.tolist()):
                a, b = base[j], base[j + 1]
                out[d].append(keys[a:b][strong[a:b]])
            sure = np.where(bands.least[band[todo]] == 1, empty <= bands.spare[band[todo]], spared >= SPARED)
            todo = todo[~sure]
        for d in todo.tolist():  # a set with too few shingles for any cut meets all such sets of its band
            out[d].append(mix(np.array([int(band[d]) << 40 | 1 << 62], U)))
    return [np.concatenate(x) if x else np.zeros(0, U) for x in out]


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class KeyBuffer:
    """Keys of a task's classes, handed out as one binary row for each bucket of the key's value.

    A row holds the name of its flush, then for each key 48 of its bits and the class's place in the
    flush, column by column: eight bytes a key.  A flush's classes are a row of their own, in a bucket
    after those of keys.  Names come from what a flush holds, so a task that runs again says the same.
    Two keys that agree in those bits only make a candidate more.
    """

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.sigs, self.size = buckets, [], [], 0
        self.seen: set[bytes] = set()

    def add(self, sig: bytes, keys: np.ndarray) -> None:
        if not len(keys) or sig in self.seen:  # a copy in the same task has the same keys
            return
        if len(self.seen) >= SEEN_CLASSES:
            self.seen.clear()
        self.seen.add(sig)
        self.keys.append(keys)
        self.sigs.append(sig)
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= FLUSH_KEYS or len(self.keys) >= 1 << 16

    def rows(self) -> tuple[np.ndarray, list[bytes]]:
        if not self.size:
            return np.zeros(0, np.int32), []
        keys = np.concatenate(self.keys)
        place = np.repeat(np.arange(len(self.keys), dtype=np.uint16), [len(k) for k in self.keys])
        cids = b"".join(s[:8] for s in self.sigs)
        name = hashlib.blake2b(cids, digest_size=8).digest()
        self.keys, self.sigs, self.size = [], [], 0
        bucket = (keys % U(self.buckets)).astype(np.int32)
        rest = keys // U(self.buckets) & U((1 << 48) - 1)
        order = np.argsort(bucket, kind="stable")
        bucket, rest, place = bucket[order], rest[order], place[order]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        blobs = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            r = rest[a:b]
            blobs.append(name + r.astype(np.uint32).tobytes() + (r >> U(32)).astype(np.uint16).tobytes() + place[a:b].tobytes())
        at = self.buckets + int.from_bytes(name, "little") % self.buckets
        return np.append(bucket[edge[:-1]], np.int32(at)), [*blobs, name + cids]


def _nodes(blob: bytes, place: np.ndarray) -> np.ndarray:
    """64-bit names of places of a flush."""
    return mix(np.frombuffer(blob, U, 1) + place.astype(U) * _SEED[254])


def unpacked_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes) of a row of keys of KeyBuffer."""
    n = (len(blob) - 8) // 8
    low, high = np.frombuffer(blob, np.uint32, n, 8), np.frombuffer(blob, np.uint16, n, 8 + 4 * n)
    return low.astype(U) | high.astype(U) << U(32), _nodes(blob, np.frombuffer(blob, np.uint16, n, 8 + 6 * n))


class Frequent:
    """The most frequent shingles of a task: exact counts of what came before, least counts given up when full."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.seen = most, np.zeros(1 << 24, bool)
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        at = values >> U(40)
        again = values[self.seen[at]]
        self.seen[at] = True
        if not len(again):
            return
        keys, counts = np.unique(again, return_counts=True)
        all_keys, back = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([self.counts, counts]), minlength=len(all_keys)).astype(np.int64)
        if len(all_keys) > self.most:
            less = np.partition(total, -(self.most // 2))[-(self.most // 2)]
            keep = total > less
            all_keys, total = all_keys[keep], total[keep] - less
        self.keys, self.counts = all_keys, total


def cid_of(sig: bytes) -> int:
    """The 64 bits of a digest by which keys know a class; classes that share them are candidates more."""
    return int.from_bytes(sig[:8], "little", signed=True)


def _signed(docs: DataFrame, k: int, pct: int) -> tuple[DataFrame, list[int]]:
    """(uid, doc_id, th, n, sig, cid, bits) of each row, written, and the most frequent shingles.

    These are at most HOT that HOT_LEAST or more classes hold, by a mergeable summary over all documents.
    They only decide which keys are made, never which documents link.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_hash().alias("th"), "text")
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "th", "n", "sig", "cid", "bits", "h", "c"]
    kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, id_type = Frequent(), set(), None
        for batch in batches:
            id_type = batch.schema.field(1).type
            for part in slices(batch, "text"):
                sets = shingle_sets(*buffers(part.column(3)), k)
                sigs, fresh = [digest(s) for s in sets], []
                for s, sig in zip(sets, sigs):
                    if len(s) and sig not in seen:
                        if len(seen) >= SEEN_CLASSES:
                            seen.clear()
                        seen.add(sig)
                        fresh.append(s)
                if fresh:
                    found.add(np.concatenate(fresh))
                size = pa.array(np.array([len(s) for s in sets], np.int64))
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], size, pa.array(sigs, pa.binary()), pa.array([cid_of(s) for s in sigs], pa.int64()), pa.array([bitmap(s, pct).tobytes() for s in sets], pa.binary()), none, none], names=names)
        few = found.counts >= 3
        if few.any():
            none = [pa.nulls(int(few.sum()), t or id_type) for t in kinds[:7]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(found.keys[few].view(np.int64)), pa.array(found.counts[few])], names=names)

    both = written(rows.mapInArrow(tidy(run), f"uid long, doc_id {doc_type}, th long, n long, sig binary, cid long, bits binary, h long, c long"), "signed")
    often = both.where("uid is null").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_LEAST)
    return both.where("uid is not null").drop("h", "c"), [r["h"] for r in often.orderBy(F.desc("c"), "h").limit(HOT).collect()]


def _keyed(docs: DataFrame, k: int, pct: int, often: list[int], buckets: int) -> DataFrame:
    """(bucket, blob): rows of KeyBuffer with the keys of all classes."""
    shared = docs.sparkSession.sparkContext.broadcast(often)  # at most HOT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = KeyBuffer(buckets)
        hot = np.zeros(1 << 24, bool)
        hot[np.array(shared.value, np.int64).view(U) >> U(40)] = True

        def flushed() -> Iterator[pa.RecordBatch]:
            bucket, blobs = buffer.rows()
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*buffers(part.column(0)), k)
                for s, keys in zip(sets, part_keys(sets, pct, hot)):
                    if len(keys):
                        buffer.add(digest(s), keys)
                if buffer.full():
                    yield from flushed()
        yield from flushed()

    return docs.select("text").mapInArrow(tidy(run), "bucket int, blob binary")


def _stars(blobs: DataFrame, buckets: int) -> DataFrame:
    """(u, v): the cid of a class and of one that shares a key with it, one bucket of keys at a time."""

    def table(u: np.ndarray, v: np.ndarray, named: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), named))], names=["u", "v", "named"])

    def close(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = []
        for turn in range(BUCKET_SLICES if held else 0):
            parts = []
            for blob in held:
                key, node = unpacked_keys(blob)
                mine = key % U(BUCKET_SLICES) == turn
                parts.append((key[mine], node[mine]))
            key, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            lead = node[np.flatnonzero(new)][np.cumsum(new) - 1]
            far = lead != node
            found.append(np.unique(np.stack([lead[far], node[far]], axis=1), axis=0))
        if sum(map(len, found)):
            pairs = np.unique(np.concatenate(found), axis=0)
            yield table(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket >= buckets:
                    cids = np.frombuffer(blob, U, -1, 8)
                    yield table(_nodes(blob, np.arange(len(cids))), cids, True)
                    continue
                if bucket != at:
                    yield from close(held)
                    at, held = bucket, []
                held.append(blob)
        yield from close(held)

    dealt = blobs.repartition(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    found = written(dealt.mapInArrow(tidy(run), "u long, v long, named boolean").distinct(), "stars")
    names = found.where("named")
    x, y = (names.select(F.col("u").alias(f"{c}_node"), F.col("v").alias(f"{c}_cid")) for c in "xy")
    pairs = found.where("not named").join(x, F.col("u") == F.col("x_node")).join(y, F.col("v") == F.col("y_node"))
    return pairs.select(F.col("x_cid").alias("u"), F.col("y_cid").alias("v"))


def bitmap(s: np.ndarray, pct: int) -> np.ndarray:
    """The signature of a set: bit h mod width is the parity of its shingles there; wider for larger sets."""
    width = 1 << int(np.clip(np.ceil(np.log2(max(1, 4 * (100 - pct) * 2 * len(s) / (100 + pct)))), 8, 14))
    return np.packbits(np.bincount((s & U(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1)


class Signatures:
    """Signatures of sets in the order of their sizes, folded to each smaller width that a pair may need."""

    def __init__(self, maps: list[np.ndarray]):
        self.own = np.array([len(m) for m in maps])
        self.levels: dict[int, tuple[int, np.ndarray]] = {}
        for w in sorted(set(self.own.tolist())):
            first = int(np.argmax(self.own >= w))
            folded = [np.bitwise_xor.reduce(m.reshape(-1, w), axis=0) for m in maps[first:]]
            self.levels[w] = first, np.stack(folded).view(U)

    def distance(self, i: int, others: np.ndarray) -> np.ndarray:
        """At most the number of shingles in which set i and the others differ."""
        width = np.minimum(self.own[others], self.own[i])
        out = np.zeros(len(others), np.int64)
        for w in np.unique(width).tolist():
            first, rows = self.levels[w]
            sel = width == w
            out[sel] = np.bitwise_count(rows[others[sel] - first] ^ rows[i - first]).sum(axis=1, dtype=np.int64)
        return out


def linked(n: np.ndarray, maps: list[np.ndarray], pct: int, sets: list[np.ndarray] | None = None, group: np.ndarray | None = None, pivots: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets in the order of their sizes ``n``; without ``sets``, of
    the pairs that their signatures allow to link.

    Sets of one ``group`` are joined already; with ``pivots`` (places), only pairs with one of these count.
    """
    if len(n) < 2:
        return []
    marks, found = Signatures(maps), []
    group = np.arange(len(n)) if group is None else np.unique(group, return_inverse=True)[1]
    last = np.searchsorted(n, n * 100 // pct, "right")
    least = np.searchsorted(n, -(-n * pct // 100), "left")
    for i in range(len(n) - 1) if pivots is None else pivots.tolist():
        for a in range(i + 1 if pivots is None else int(least[i]), int(last[i]), 4096):
            b = min(a + 4096, int(last[i]))
            free = np.flatnonzero(group[a:b] != group[i]) + a
            if not len(free):
                continue
            over = (n[i] + n[free] - marks.distance(i, free)) // 2
            for j in free[100 * over >= pct * (n[i] + n[free] - over)].tolist():
                if group[j] == group[i]:
                    continue
                if sets is not None:
                    x, y = (i, j) if len(sets[i]) <= len(sets[j]) else (j, i)
                    at = np.minimum(np.searchsorted(sets[y], sets[x]), len(sets[y]) - 1)
                    both = int((sets[y][at] == sets[x]).sum())
                    if 100 * both < pct * (n[i] + n[j] - both):
                        continue
                found.append((i, j))
                group[group == group[j]] = group[i]
    return found


def _compared(rows: list[tuple], pct: int, sets: list[np.ndarray] | None, maps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The links of a tile's rows (cls, n, grp, pivot, ...)."""
    pivots = np.flatnonzero([r[3] for r in rows])
    found = linked(np.array([r[1] for r in rows], np.int64), maps, pct, sets, np.array([r[2] for r in rows], np.int64), pivots if len(pivots) else None)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in found], pa.int64()), pa.array([rows[j][0] for _, j in found], pa.int64())], names=["u", "v"])


def _by_tile(batches: Iterator[pa.RecordBatch], close: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``close`` with the rows of each tile of batches sorted by tile (their first column), each
    class once; of a class that is a pivot and a member the pivot's row comes first."""
    tile, rows = None, []
    for batch in batches:
        for t, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if t != tile:
                yield from close(rows)
                tile, rows = t, []
            if not rows or rows[-1][0] != row[0]:
                rows.append(tuple(row))
    yield from close(rows)


def _dealt(tiles: DataFrame, *columns: str) -> DataFrame:
    x = tiles.repartition(F.col("tile")).sortWithinPartitions("tile", "n", "cls", F.desc("pivot"))
    return x.select("tile", "cls", "n", "grp", "pivot", *columns)


def _allowed(tiles: DataFrame, pct: int) -> DataFrame:
    """(u, v): a forest of the pairs that signatures allow, from tiles (with column bits)."""

    def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            yield from _compared(rows, pct, None, [np.frombuffer(r[4], np.uint8) for r in rows])

    return _dealt(tiles, "bits").mapInArrow(tidy(lambda batches: _by_tile(batches, close)), "u long, v long")


def _links(tiles: DataFrame, k: int, pct: int) -> DataFrame:
    """(u, v): a forest of the links found in tiles (with columns sig, text)."""

    def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        sets, held = [], []
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            for row, s in zip(part, shingle_sets(*buffers(pa.array([x[5] for x in part], pa.string())), k)):
                if digest(s) == row[4]:
                    held.append(row[:4])
                    sets.append(s)
        yield from _compared(held, pct, sets, [bitmap(s, pct) for s in sets])

    return _dealt(tiles, "sig", "text").mapInArrow(tidy(lambda batches: _by_tile(batches, close)), "u long, v long")


def _band(n: Column, pct: int) -> Column:
    """A size band as SQL; pairs that link lie in one or in neighbours."""
    return F.floor(F.ln(n) / F.ln(F.lit(100.0 / pct)) * 0.999).cast("long")


def _grouped(far: DataFrame, label: DataFrame) -> DataFrame:
    """``far`` with the group of each class, and whether it is outside its cluster's largest one (rest)."""
    x = far.drop("grp", "rest").join(label, F.col("cls") == F.col("node"), "left")
    x = x.withColumn("grp", F.coalesce("root", "cls")).drop("node", "root")
    count = x.groupBy("cluster", "grp").agg(F.count(F.lit(1)).alias("m"))
    main = count.groupBy("cluster").agg(F.max(F.struct("m", "grp")).alias("top")).select(F.col("cluster").alias("m_cluster"), F.col("top.grp").alias("main"))
    x = x.join(main, F.col("cluster") == F.col("m_cluster")).withColumn("rest", F.col("grp") != F.col("main"))
    return written(x.drop("m_cluster", "main"), "grouped")


def _pivot_tiles(far: DataFrame, weight: Column, fine: int, turn: int) -> DataFrame:
    """Tiles of blocks of a band, each with the pivots of the band and its neighbours: one class of each
    band, of those outside the largest group."""
    by = ["cluster", "band"]
    blocks = far.groupBy(*by).agg(F.least(F.ceil(F.sum(weight) / fine), F.lit(MOST_BLOCKS)).cast("long").alias("blocks"))
    blocks = blocks.select(F.col("cluster").alias("b_cluster"), F.col("band").alias("b_band"), "blocks")
    tile = lambda band, block: F.xxhash64("cluster", band, block)
    member = far.join(blocks, (F.col("cluster") == F.col("b_cluster")) & (F.col("band") == F.col("b_band")))
    member = member.withColumn("tile", tile("band", F.pmod(F.xxhash64("cls"), F.col("blocks"))))
    chosen = far.where("rest").groupBy(*by).agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("at"), "cls")).alias("p")).select(F.col("p.cls").alias("p_cls"))
    pivot = far.join(chosen, F.col("cls") == F.col("p_cls")).withColumn("pivot", F.lit(True)).withColumn("near", F.explode(F.expr("sequence(band - 1, band + 1)")))
    pivot = pivot.join(blocks, (F.col("cluster") == F.col("b_cluster")) & (F.col("near") == F.col("b_band")))
    pivot = pivot.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("tile", tile("near", F.col("block")))
    names = [*far.columns, "tile"]
    return member.select(*names).unionByName(pivot.select(*names))


def _rest_tiles(far: DataFrame, weight: Column, fine: int, most: int) -> DataFrame:
    """Tiles of two blocks of a band or of neighbours, of which one at least lies outside the largest group."""
    size = F.sum(weight)
    count = far.groupBy("cluster", "band", "rest").agg(F.greatest(F.least(F.ceil(size / fine), F.lit(FEW_BLOCKS)), F.ceil(size / most)).cast("long").alias("blocks"))
    count = count.groupBy(F.col("cluster").alias("b_cluster")).agg(F.collect_list(F.struct("band", "rest", "blocks")).alias("all"))  # two for each band
    x = far.join(count, F.col("cluster") == F.col("b_cluster"))
    own = F.filter("all", lambda b: (b["band"] == F.col("band")) & (b["rest"] == F.col("rest")))[0]["blocks"]
    mine = F.struct(F.col("band").alias("band"), F.col("rest").alias("rest"), F.pmod(F.xxhash64("cls"), own).alias("block"))
    near = F.filter("all", lambda b: (F.abs(b["band"] - F.col("band")) <= 1) & (F.col("rest") | b["rest"]))
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["blocks"] - 1), lambda i: F.struct(b["band"].alias("band"), b["rest"].alias("rest"), i.alias("block")))))
    x = x.withColumn("mine", mine).withColumn("other", F.explode(others))
    x = x.withColumn("tile", F.xxhash64("cluster", F.least("mine", "other"), F.greatest("mine", "other")))
    return x.select(*far.columns, "tile")


def _forest(cand: DataFrame, held: DataFrame, pct: int, weight: Column, fine: int, most: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the links that ``compare`` finds among the classes of each cluster.

    ``held`` (cls, ...) is what it compares; ``weight`` summed over the classes of a block comes to about
    ``fine`` or at most ``most``.
    """
    c = cand.withColumn("band", _band(F.col("n"), pct)).withColumns({"grp": F.col("cls"), "rest": F.lit(True), "pivot": F.lit(False)})
    big = written(c.groupBy("cluster").agg(F.sum(weight).alias("w")).where(F.col("w") > 2 * fine).select(F.col("cluster").alias("big")), "big")
    small = c.join(big, F.col("cluster") == F.col("big"), "left_anti").withColumn("tile", F.xxhash64("cluster"))
    links = [written(compare(small.join(held, "cls")), "links")]
    if not big.isEmpty():
        far = written(c.join(big, F.col("cluster") == F.col("big"), "left_semi"), "grouped")
        far_held = written(held.join(far, "cls", "left_semi"), "held")
        rest = True
        for turn in range(PIVOT_ROUNDS):
            links.append(written(compare(_pivot_tiles(far, weight, fine, turn).join(far_held, "cls")), "links"))
            label = components(_union(links[1:]))
            before, far = far, _grouped(far, label)
            discard(before)
            rest = not far.where("rest").isEmpty()
            if not rest:
                break
        if rest:
            links.append(written(compare(_rest_tiles(far, weight, fine, most).join(far_held, "cls")), "links"))
        discard(far, far_held)
    root = components(_union(links))
    discard(big, *links)
    return root


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def hit_filter(keys: DataFrame, value: Column) -> DataFrame:
    """A filter of FILTER_BITS bits of ``value``: up to 512 rows (filter_page, filter_bits) of 4 KB."""
    v = F.pmod(value, F.lit(FILTER_BITS)) + 1
    return keys.select(v.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("filter_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("v"))).alias("filter_bits"))


def with_hit(df: DataFrame, value: Column, pages: DataFrame) -> DataFrame:
    """``df`` with a column filter_hit: false only if ``value`` isn't among the filter's keys."""
    v = F.pmod(value, F.lit(FILTER_BITS)) + 1
    x = df.withColumn("filter_v", v).withColumn("filter_at", F.bitmap_bucket_number("filter_v"))
    x = x.join(F.broadcast(pages), F.col("filter_at") == F.col("filter_page"), "left")
    pos = F.bitmap_bit_position(F.col("filter_v"))
    byte = F.conv(F.hex(F.substring("filter_bits", F.expr("cast(bitmap_bit_position(filter_v) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.get(F.array(*(byte.bitwiseAND(1 << i) != 0 for i in range(8))), (pos % 8).cast("int")), F.lit(False))
    return x.withColumn("filter_hit", hit).drop("filter_v", "filter_at", "filter_page", "filter_bits")


def classes(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """One row for each row of ``docs``: uid, doc_id, th (a hash of the text), n, component_id, and
    first (the row stands for its component: the smallest doc_id, then the smallest uid)."""
    base = docs.select("doc_id", "text")
    signed, often = _signed(base, k, pct)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    some = F.min(F.struct("uid", "doc_id", "th", "n", "cid", "bits")).alias("r")
    slim = written(signed.where("n > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("top"), some).select("sig", "copies", "top", F.col("r.uid").alias("cls"), "r.doc_id", "r.th", "r.n", "r.cid", "r.bits"), "classes")
    shingles = slim.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, shingles // BUCKET_SHINGLES)
    cluster = components(_stars(_keyed(base, k, pct, often, buckets), buckets))
    cand = written(cluster.join(slim, F.col("node") == F.col("cid")).select("cls", F.col("root").alias("cluster"), "sig", "n", "bits", "doc_id", "th"), "candidates")
    tight = _forest(cand.select("cls", "cluster", "n"), cand.select("cls", "bits"), pct, F.lit(1), TILE_CLASSES, MOST_CLASSES, lambda tiles: _allowed(tiles, pct))
    before, cand = cand, written(cand.drop("cluster", "bits").join(tight, F.col("cls") == F.col("node")).withColumnRenamed("root", "cluster").drop("node"), "candidates")
    discard(before)
    pages = written(hit_filter(cand, F.xxhash64("doc_id", "th")), "filter")
    texts = with_hit(base.select(F.col("doc_id").alias("d_id"), text_hash().alias("d_th"), "text"), F.xxhash64("d_id", "d_th"), pages).where("filter_hit")
    texts = texts.groupBy("d_id", "d_th").agg(F.max("text").alias("text"))  # of rows that repeat, one
    texts = written(cand.select("cls", "sig", "doc_id", "th").join(texts, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th"))).select("cls", "sig", "text"), "texts")
    label = _forest(cand.select("cls", "cluster", "n"), texts, pct, F.col("n"), TILE_SHINGLES, MOST_SHINGLES, lambda tiles: _links(tiles, k, pct))
    discard(cand, pages, texts)
    named = slim.join(label, F.col("cls") == F.col("node"), "left").select("sig", "top", "copies", "root", F.coalesce("root", "cls").alias("comp"))
    named = named.where("copies > 1 or root is not null")
    best = named.groupBy("comp").agg(F.min("top").alias("best")).withColumnRenamed("comp", "b_comp")
    # a component's own name goes to its classes; only classes with copies or links are in this table
    to = named.join(best, F.col("comp") == F.col("b_comp")).select(F.col("sig").alias("c_sig"), "best")
    x = signed.select("uid", "doc_id", "th", "n", "sig").join(to, (F.col("sig") == F.col("c_sig")) & (F.col("n") > 0), "left")
    alone = F.col("best").isNull()
    return x.select("uid", "doc_id", "th", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), (alone | (F.col("best.uid") == F.col("uid"))).alias("first"))


def one_of_each(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """The documents that stand for their component, with the columns of ``docs``; one row of each."""
    names = docs.columns
    found = written(classes(docs, k, pct), "components")
    key = F.xxhash64("doc_id", "th")
    # a (doc_id, text) goes if none of its rows is first; of rows that repeat and are first, one stays
    act = found.groupBy("doc_id", "th").agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    act = written(act.where("not stays or (rows > 1 and n > 0)").select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), "stays"), "actions")
    pages = written(hit_filter(act, F.xxhash64("a_id", "a_th")), "filter")
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), "doc_id", text_hash().alias("th"))
    inner = with_hit(inner, key, pages)
    out = [f"c{i}" for i in range(len(names))]
    hit = inner.where("filter_hit").join(act, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("th") == F.col("a_th")), "left")
    passed = inner.where("not filter_hit").select(*out).union(hit.where("stays is null").select(*out)).union(hit.where("stays").dropDuplicates(["doc_id", "th"]).select(*out))
    return passed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, pct=90)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
