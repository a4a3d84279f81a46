"""The store's verbs, over several generations."""

import json
import random

import pytest

from tensorquay.functions.chunking import Params
from tensorquay.store import Store, StoreError


def test_verbs(spark, tmp_path):
    s = Store(spark, "file://" + str(tmp_path), Params(64, 256, 1024))
    with pytest.raises(StoreError):
        s.generation  # noqa: B018
    assert s.init() == 1
    rng = random.Random(1)
    big = rng.randbytes(5000)
    put = lambda *rows: s.put(spark.createDataFrame(list(rows), "path string, content binary"))
    put(("/a/b/one.bin", big), ("/a/two.bin", big), ("/t.txt", b"hello"))
    st = s.status()
    assert (st["files"], st["dirs"], st["bytes"]) == (3, 2, 10005) and st["stored"] == 5005  # equal contents once
    assert s.get("/a/b/one.bin") == big and s.read_slice("/a/two.bin", 700, 900) == big[700:1600] and s.read_slice("/t.txt", 9, 5) == b""
    assert [r["name"] for r in s.ls("/").collect()] == ["a", "t.txt"]
    at = s.generation
    for call in (lambda: s.mkdir("/a"), lambda: s.mkdir("/x/y"), lambda: s.rmdir("/a"), lambda: s.unlink("/a"), lambda: s.get("/a"), lambda: put(("/a", b"")), lambda: s.ls("/t.txt")):
        with pytest.raises(StoreError):
            call()
    assert s.generation == at  # what is not allowed commits nothing
    s.mkdir("/x/y", parents=True)
    s.rm("/x/y")
    s.rm("/a/two.bin")
    put(("/a/b/one.bin", big[:100] + b"!" + big[100:]))
    assert s.get("/a/b/one.bin")[100:101] == b"!" and s.status()["stored"] == 5006  # the former chunks are gone
    assert [r["path"] for r in s.walk().collect()] == ["/a", "/a/b", "/a/b/one.bin", "/t.txt", "/x"]


def test_tools(spark, tmp_path):
    s = Store(spark, "file://" + str(tmp_path))
    s.init()
    s.put(spark.createDataFrame([("/d/t.txt", b"hello"), ("/long", b"x" * 20000)], "path string, content binary"))
    assert json.loads(s.tool("ls", '{"path": "/"}')) == [{"name": "d", "kind": "dir", "size_bytes": 0}, {"name": "long", "kind": "file", "size_bytes": 20000}]
    read = json.loads(s.tool("read", '{"path": "/long"}'))
    assert read["truncated"] and len(read["content"]) == 16384
    assert json.loads(s.tool("stat", '{"path": "/d/t.txt"}'))["crc32"] == "3610a686"
    assert "error" in json.loads(s.tool("read", "not json")) and "error" in json.loads(s.tool("format", "{}")) and "error" in json.loads(s.tool("stat", '{"path": "/no"}'))
    replies = iter([{"role": "assistant", "tool_calls": [{"id": "1", "name": "list_all_files", "arguments": "{}"}]}, {"role": "assistant", "content": "done"}])
    talk = s.converse(lambda m: next(replies), [{"role": "user", "content": "?"}])
    assert [m["role"] for m in talk] == ["user", "assistant", "tool", "assistant"] and len(json.loads(talk[2]["content"])) == 2
    with pytest.raises(StoreError):
        s.converse(lambda m: {"role": "assistant", "tool_calls": [{"name": "ls", "arguments": '{"path": "/"}'}]}, [])
