"""Command line: capture, search, recall and status of a memory folder, and registered queries."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import queries
from .functions import text as tx
from .operators import query
from .plans.memory import Memory, render
from .sources import logs


def rows(memory: Memory, a: argparse.Namespace) -> str:
    """A page of a layer's rows by filters and times, newest first unless asked otherwise."""
    now, df = int(time.time() * 1000), getattr(memory, a.layer)
    column = "timestamp" if a.layer == "l0" else "updated_time"
    at = lambda x: None if x is None else tx.parse_when(x, now) if a.layer == "l0" else tx.millis_to_iso(F.lit(tx.parse_when(x, now)))
    df = query.time_range(query.where(df, a.where), column, at(a.since), at(a.until))
    page = query.page(df, column, a.limit, a.offset, not a.ascending)
    return render(page, a.form, a.limit, {"level": a.layer, "total": df.count(), "offset": a.offset, "limit": a.limit, "sort": column, "filter": a.where})


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("--path", default="memory", help="folder of the layers")
    p.add_argument("--form", default="json", choices=("json", "jsonl", "table", "lines"))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("capture", help="take new messages of a log").add_argument("log")
    for name in ("memories", "conversations"):
        s = sub.add_parser(name, help=f"search {name}")
        s.add_argument("text")
        s.add_argument("--limit", type=int, default=5)
    sub.add_parser("recall", help="facts for a turn").add_argument("text")
    sub.add_parser("status", help="rows of both layers")
    s = sub.add_parser("seed", help="replay a seed file")
    s.add_argument("file")
    s.add_argument("--start", default="0s", help="time of the first message, if the file has none: 3d (ago) or ISO 8601")
    s = sub.add_parser("rows", help="rows of a layer")
    s.add_argument("layer", choices=("l0", "l1"))
    s.add_argument("--where", default="", help="such as role=user,timestamp>=5")
    s.add_argument("--since", help="3d (ago) or ISO 8601")
    s.add_argument("--until")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--ascending", action="store_true")
    sub.add_parser("retain", help="drop what is older than the configured days")
    s = sub.add_parser("query", help="a registered query over a folder of test tables")
    s.add_argument("name", choices=sorted(queries.QUERIES))
    s.add_argument("tables")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    memory = Memory(spark, a.path)
    if a.command == "capture":
        print(memory.capture(logs.read_messages(spark, a.log)))
    elif a.command == "recall":
        print("\n".join(memory.recall(a.text)["lines"]))
    elif a.command == "query":
        print(render(queries.QUERIES[a.name](spark, a.tables), a.form))
    elif a.command == "seed":
        print(memory.seed(a.file, tx.parse_when(a.start, int(time.time() * 1000))))
    elif a.command == "retain":
        print(render(memory.retain(int(time.time() * 1000)), a.form))
    elif a.command == "rows":
        print(rows(memory, a))
    elif a.command == "status":
        print(render(memory.status(), a.form))
    else:
        found = memory.search_memories(a.text, a.limit) if a.command == "memories" else memory.search_conversations(a.text, a.limit)
        print(render(found, a.form))


if __name__ == "__main__":
    main()
