"""Fixed little-endian records as column expressions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def little(value: Column, size: int) -> Column:
    """A whole number as ``size`` little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return bound(digits, lambda d: F.unhex(F.concat(*(F.substring(d, 2 * i + 1, 2) for i in reversed(range(size))))))


def number(raw: Column, at: int, size: int) -> Column:
    """``size`` little-endian bytes of a binary column as a whole number."""
    return bound(F.hex(F.substring(raw, at + 1, size)), lambda d: F.conv(F.concat(*(F.substring(d, 2 * i + 1, 2) for i in reversed(range(size)))), 16, 10).cast("long"))


def packed_pointer(slot: Column, start: Column, bits: Column, flags: Column) -> Column:
    """slot (2 bytes), start (4), bits (4), flags (2), four zero bytes."""
    return F.concat(little(slot, 2), little(start, 4), little(bits, 4), little(flags, 2), little(F.lit(0), 4))


def unpacked_pointer(raw: Column) -> Column:
    """The fields of a pointer; null if it is null (no bits), of another length or has reserved bytes set."""

    def fields(r: Column) -> Column:
        good = (F.length(r) == 16) & (number(r, 12, 4) == 0) & (number(r, 6, 4) > 0)
        return F.when(good, F.struct(number(r, 0, 2).cast("int").alias("slot"), number(r, 2, 4).alias("start"), number(r, 6, 4).cast("int").alias("bits"), number(r, 10, 2).cast("int").alias("flags")))

    return bound(raw, fields)


def packed_anchor(generation: Column, pointer: Column) -> Column:
    """generation (8 bytes), pointer, CRC-32 of both."""
    return bound(F.concat(little(generation, 8), pointer), lambda body: F.concat(body, little(F.crc32(body), 4)))


def unpacked_anchor(raw: Column) -> Column:
    """generation and pointer of an anchor slot; null if its checksum fails."""

    def fields(r: Column) -> Column:
        good = (F.length(r) == 28) & (F.crc32(F.substring(r, 1, 24)) == number(r, 24, 4))
        return F.when(good, F.struct(number(r, 0, 8).alias("generation"), F.substring(r, 9, 16).alias("pointer")))

    return bound(raw, fields)


def pack_directory(entries: list[tuple[str, int, int]]) -> bytes:
    """A directory's record: a count, then name, kind and inode of each entry, by name in byte order."""
    seen = [n.encode() for n, _, _ in entries]
    if len(set(seen)) != len(seen):
        raise ValueError("duplicate name")
    out = [struct.pack("<I", len(entries))]
    for name, kind, inode in sorted(entries, key=lambda e: e[0].encode()):
        raw = name.encode()
        if not 1 <= len(raw) <= 255 or "/" in name or "\0" in name:
            raise ValueError("invalid name")
        out.append(struct.pack("<HBBQ", len(raw), kind, 0, inode) + raw)
    return b"".join(out)


def unpack_directory(raw: bytes) -> list[tuple[str, int, int]]:
    """The entries of a directory's record; an error for truncation, bad kinds, reserved bytes, repeats or a rest."""
    (count,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(count):
        if at + 12 > len(raw):
            raise ValueError("truncated")
        size, kind, reserved, inode = struct.unpack_from("<HBBQ", raw, at)
        if kind not in (0, 1) or reserved:
            raise ValueError("bad kind or reserved byte")
        name = raw[at + 12 : at + 12 + size]
        if len(name) != size:
            raise ValueError("truncated")
        out.append((name.decode(), kind, inode))
        at += 12 + size
    if at != len(raw):
        raise ValueError("trailing bytes")
    if len({n for n, _, _ in out}) != len(out):
        raise ValueError("duplicate name")
    return sorted(out, key=lambda e: e[0].encode())


MAGIC, VERSION = b"TQSR", 2


def pack_manifest(generation: int, pointers: list[bytes]) -> bytes:
    """A snapshot's root: magic, version, generation, six pointers, CRC-32."""
    if len(pointers) != 6 or any(len(p) != 16 for p in pointers):
        raise ValueError("six pointers of sixteen bytes are needed")
    body = MAGIC + struct.pack("<IQ", VERSION, generation) + b"".join(pointers)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_manifest(raw: bytes) -> tuple[int, list[bytes]]:
    if len(raw) != 116 or raw[:4] != MAGIC:
        raise ValueError("bad length or magic")
    version, generation = struct.unpack_from("<IQ", raw, 4)
    if version != VERSION:
        raise ValueError("bad version")
    if zlib.crc32(raw[:112]) != struct.unpack_from("<I", raw, 112)[0]:
        raise ValueError("bad checksum")
    return generation, [raw[16 + 16 * i : 32 + 16 * i] for i in range(6)]
