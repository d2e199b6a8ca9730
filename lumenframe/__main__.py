"""Command line: python -m lumenframe STORE search|recent|activity|stats|serve|tools ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from lumenframe.api import Service, answer, serve
from lumenframe.functions.crypto import key_from_environment
from lumenframe.operators import frames as R
from lumenframe.sources.store import MemoryStore, load_config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenframe")
    top.add_argument("store", help="folder of the store")
    top.add_argument("--config", help="JSON file of settings")
    sub = top.add_subparsers(dest="command", required=True)
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=20)
    recent = sub.add_parser("recent")
    recent.add_argument("--minutes", type=float, default=30)
    recent.add_argument("--limit", type=int, default=50)
    sub.add_parser("activity").add_argument("--minutes", type=float, default=60)
    sub.add_parser("stats")
    watch = sub.add_parser("watch", help="append JSON files of captures that arrive in a folder")
    watch.add_argument("folder")
    watch.add_argument("--checkpoint", required=True)
    sub.add_parser("serve").add_argument("--port", type=int, default=8765)
    sub.add_parser("tools", help="answer JSON requests on standard input")
    return top


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumenframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = MemoryStore(spark, args.store, key_from_environment())
    service = Service(store, time.time, load_config(args.config))
    if args.command in ("search", "recent"):
        found = service.search(args.query, args.limit) if args.command == "search" else service.recent(args.minutes, args.limit)
        if found:
            for row in R.entry_lines(spark.createDataFrame(found)).collect():
                print(row.line)
    elif args.command == "activity":
        print(service.activity(args.minutes))
    elif args.command == "stats":
        print(json.dumps(service.stats(), default=str))
    elif args.command == "watch":
        from lumenframe.streaming.pipeline import KEPT, ingest

        stream = spark.readStream.schema(KEPT).json(args.folder)
        ingest(stream, store, lambda: load_config(args.config), args.checkpoint, available_now=False, changes_only=True).awaitTermination()
    elif args.command == "serve":
        serve(service, args.port).serve_forever()
    else:
        for line in sys.stdin:
            print(answer(service, line), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
