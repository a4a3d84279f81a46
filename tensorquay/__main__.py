"""python -m tensorquay FOLDER VERB ...: a store from the command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .session import local_session, ship
from .store import Store, StoreError


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tensorquay")
    p.add_argument("folder", help="where the store's generations are")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init")
    verbs.add_parser("status")
    verbs.add_parser("ls").add_argument("path", nargs="?", default="/")
    put = verbs.add_parser("store")
    put.add_argument("host")
    put.add_argument("--path")
    get = verbs.add_parser("get")
    get.add_argument("path")
    get.add_argument("--output")
    verbs.add_parser("rm").add_argument("path")
    mk = verbs.add_parser("mkdir")
    mk.add_argument("path")
    mk.add_argument("--parents", action="store_true")
    a = p.parse_args(args)
    spark = local_session("*")
    ship(spark)
    store = Store(spark, a.folder)
    try:
        if a.verb == "init":
            print(f"generation {store.init()}")
        elif a.verb == "status":
            print("\n".join(f"{k}: {v}" for k, v in store.status().items()))
        elif a.verb == "ls":
            for r in store.ls(a.path).collect():
                print(f"{r['name']}/" if r["kind"] == "dir" else f"{r['length']}\t{r['name']}")
        elif a.verb == "store":
            to = a.path or "/" + Path(a.host).name
            store.put(spark.createDataFrame([(to, Path(a.host).read_bytes())], "path string, content binary"))
        elif a.verb == "get":
            raw = store.get(a.path)
            Path(a.output).write_bytes(raw) if a.output else sys.stdout.buffer.write(raw)
        elif a.verb == "rm":
            store.rm(a.path)
        else:
            store.mkdir(a.path, a.parents)
    except StoreError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
