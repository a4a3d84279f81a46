"""A content store over snapshots: files and directories, chunks stored once, verbs as set operations.

Tables of a generation: entries (path, kind, length, digest), chunks (path, place, digest, length) and
contents (digest, bytes).  Each verb reads the newest valid generation and commits the next; a verb that
is not allowed raises and commits nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chunking import Params
from .operators import content as C
from .operators import trees as T

READ_LIMIT = 16_384
ROUNDS = 8


class StoreError(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, folder: str, params: Params = Params()):
        self.spark, self.snapshots, self.params = spark, C.Snapshots(spark, folder), params

    def _empty(self) -> dict[str, DataFrame]:
        make = self.spark.createDataFrame
        return {
            "entries": make([], "path string, kind string, length long, digest string"),
            "chunks": make([], "path string, place int, start int, length int, digest string"),
            "contents": make([], "digest string, bytes binary"),
        }

    def init(self) -> int:
        """A new, empty generation; what was there before is no longer reachable."""
        return self.snapshots.commit(self._empty())

    @property
    def generation(self) -> int:
        newest = self.snapshots.manifests()
        if not newest:
            raise StoreError("not initialised")
        return newest[0]["generation"]

    def table(self, name: str) -> DataFrame:
        return self.snapshots.read(name)

    def _kind(self, path: str) -> str | None:
        if path == "/":
            return "dir"
        found = self.table("entries").where(F.col("path") == path).select("kind").first()
        return found["kind"] if found else None

    def _commit(self, entries: DataFrame, chunks: DataFrame | None = None, contents: DataFrame | None = None) -> int:
        chunks = self.table("chunks") if chunks is None else chunks
        chunks = chunks.join(entries.where("kind = 'file'").select("path"), "path", "left_semi")
        contents = self.table("contents") if contents is None else contents
        contents = contents.join(chunks.select("digest"), "digest", "left_semi")  # chunks no file holds are reclaimed
        return self.snapshots.commit({"entries": entries, "chunks": chunks, "contents": contents}, expected=self.generation)

    def _done(self, entries: DataFrame, said: DataFrame, good: str) -> int:
        bad = said.where(F.col("outcome") != good).first()
        if bad:
            raise StoreError(f"{bad['path']}: {bad['outcome']}")
        return self._commit(entries)

    def mkdir(self, path: str, parents: bool = False) -> int:
        paths = self.spark.createDataFrame([(path,)], "path string")
        if parents:
            up = path.strip("/").split("/")
            for i in range(1, len(up)):
                part = "/" + "/".join(up[:i])
                if self._kind(part) is None:
                    self.mkdir(part)
        return self._done(*T.made_directories(self.table("entries"), paths), "made")

    def rmdir(self, path: str) -> int:
        return self._done(*T.removed_directories(self.table("entries"), self.spark.createDataFrame([(path,)], "path string")), "removed")

    def unlink(self, path: str) -> int:
        return self._done(*T.unlinked(self.table("entries"), self.spark.createDataFrame([(path,)], "path string")), "removed")

    def rm(self, path: str) -> int:
        """A file, or else an empty directory."""
        return self.rmdir(path) if self._kind(path) == "dir" else self.unlink(path)

    def put(self, files: DataFrame) -> int:
        """Create or overwrite files (path, content); directories above them are made, equal chunks stored once."""
        files = files.select("path", F.col("content").cast("binary").alias("content"))
        new = T.from_files(files)
        entries = self.table("entries")
        clash = new.where("kind = 'file'").join(entries.where("kind = 'dir'").select("path"), "path", "left_semi").first()
        if clash:
            raise StoreError(f"{clash['path']}: is_a_directory")
        dirs = new.where("kind = 'dir'").join(entries.select("path"), "path", "left_anti")
        after = T.put_files(entries.unionByName(dirs), files)
        pieces = C.chunked(files, self.params)
        kept = self.table("chunks").join(files.select("path"), "path", "left_anti")
        chunks = kept.unionByName(pieces.select("path", "place", "start", "length", "digest"))
        fresh = C.stored(pieces.select("digest", "bytes"), self.table("contents"))
        return self._commit(after, chunks, self.table("contents").unionByName(fresh.select("digest", "bytes")))

    def get(self, path: str) -> bytes:
        kind = self._kind(path)
        if kind != "file":
            raise StoreError(f"{path}: {'missing' if kind is None else 'is_a_directory'}")
        own = self.table("chunks").where(F.col("path") == path).join(self.table("contents"), "digest")
        return b"".join(bytes(r["bytes"]) for r in own.select("place", "bytes").orderBy("place").collect())  # one file's bytes

    def read_slice(self, path: str, offset: int, size: int) -> bytes:
        """The bytes of a range, from the chunks that it touches."""
        own = self.table("chunks").where((F.col("path") == path) & (F.col("start") < offset + size) & (F.col("start") + F.col("length") > offset))
        rows = own.join(self.table("contents"), "digest").select("start", "bytes").orderBy("start").collect()
        if not rows:
            return b""
        return b"".join(bytes(r["bytes"]) for r in rows)[offset - rows[0]["start"] :][:size]

    def ls(self, path: str = "/") -> DataFrame:
        if self._kind(path) != "dir":
            raise StoreError(f"{path}: not_a_directory")
        return T.listing(self.table("entries"), path)

    def walk(self) -> DataFrame:
        return T.walked(self.table("entries"))

    def status(self) -> dict:
        e = self.table("entries").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        c = self.table("contents").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("bytes")), F.lit(0)).alias("stored")).first()
        return {"generation": self.generation, **e.asDict(), **c.asDict()}

    def tool(self, name: str, arguments: str) -> str:
        """One tool call: its answer as JSON. Arguments that are not JSON count as none."""
        try:
            given = json.loads(arguments)
        except ValueError:
            given = {}
        path = given.get("path") if isinstance(given, dict) else None
        try:
            if name == "list_all_files":
                rows = self.walk().where("kind = 'file'").select("path", F.col("length").alias("size_bytes"))
                return json.dumps([r.asDict() for r in rows.collect()])
            if name not in ("ls", "read", "stat"):
                raise StoreError(f"unknown tool {name}")
            if path is None:
                raise StoreError("a path is needed")
            if name == "ls":
                return json.dumps([{"name": r["name"], "kind": r["kind"], "size_bytes": r["length"]} for r in self.ls(path).collect()])
            kind = self._kind(path)
            if kind is None:
                raise StoreError(f"{path}: missing")
            if name == "stat" and kind == "dir":
                return json.dumps({"path": path, "kind": "dir", "size_bytes": 0})
            raw = self.get(path)
            if name == "stat":
                import zlib

                return json.dumps({"path": path, "kind": "file", "size_bytes": len(raw), "crc32": f"{zlib.crc32(raw):08x}"})
            return json.dumps({"path": path, "truncated": len(raw) > READ_LIMIT, "content": raw[:READ_LIMIT].decode("utf-8", "replace")})
        except StoreError as e:
            return json.dumps({"error": str(e)})

    def converse(self, client, messages: list[dict]) -> list[dict]:
        """The tool loop: ``client(messages)`` gives a message; its tool calls are answered, eight rounds at most."""
        out = list(messages)
        for _ in range(ROUNDS):
            reply = client(out)
            out.append(reply)
            if not reply.get("tool_calls"):
                return out
            out += [{"role": "tool", "tool_call_id": c.get("id"), "content": self.tool(c["name"], c.get("arguments", ""))} for c in reply["tool_calls"]]
        raise StoreError(f"more than {ROUNDS} rounds of tool calls")
