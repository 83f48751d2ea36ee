"""Command line: ``python -m tallyrank serve | load | benchmark``."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import SparkSession

from . import benchmark
from .service import serve
from .sources.ingest import parse_json_lines, read_json_lines
from .sources.store import Store
from .sources.versions import POLL_SECONDS, VersionedStore

#: Lines from standard input that make one batch of the store.
BATCH_LINES = 100_000
PORT = 11625


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyrank", description="Custom-score top-k retrieval on Spark.")
    commands = top.add_subparsers(dest="command", required=True, metavar="command")
    shards = {"type": int, "default": 0, "help": "taken for compatibility; Spark's partitions stand for shards"}

    own = commands.add_parser("serve", help="answer queries over HTTP")
    own.add_argument("--port", type=int, default=PORT)
    own.add_argument("--interface", default="", help="address to listen on; any by default")
    own.add_argument("--datadir", default="./data", help="folder of the store, or with --automigrate the beginning of the folders' names")
    own.add_argument("--numshards", **shards)
    own.add_argument("--readonly", action="store_true", help="answer GET only")
    own.add_argument("--automigrate", action="store_true", help="serve the last, by name, of the folders <datadir>*, and change when a later one appears")
    own.add_argument("--poll", type=float, default=POLL_SECONDS, help="seconds between looks for a later folder")

    own = commands.add_parser("load", help="append JSON lines from standard input, or from files that Spark reads")
    own.add_argument("--datadir", default="./data")
    own.add_argument("--numshards", **shards)
    own.add_argument("--batch", type=int, default=BATCH_LINES, help="lines of a batch")
    own.add_argument("files", nargs="*", help="paths of JSON lines; each call is one batch")

    own = commands.add_parser("benchmark", help="time growing stores on a CSV of census records")
    own.add_argument("--csv", required=True)
    own.add_argument("--maxrecords", type=int, default=1_000_000)
    own.add_argument("--out", default="output.csv")
    own.add_argument("--fsdatadir", default="./benchmark_data", help="folder of the new store")
    return top


def open_served(spark: SparkSession, args: argparse.Namespace):
    """The store that ``serve`` answers from, watched where it may change."""
    if not args.automigrate:
        return Store(spark, args.datadir)
    parent, _, prefix = args.datadir.rpartition("/")
    versions = VersionedStore(spark, parent or ".", prefix)
    versions.watch(args.poll)
    return versions


def _batches(lines: Iterable[str], size: int) -> Iterator[list[str]]:
    lines = iter(lines)
    while batch := list(islice(lines, size)):
        yield batch


def load_lines(store: Store, lines: Iterable[str], size: int = BATCH_LINES) -> int:
    """Append JSON lines in batches; a malformed line is an empty record. Returns the number of stored records."""
    total = 0
    for batch in _batches(lines, max(size, 1)):
        text = store.spark.createDataFrame([(line.rstrip("\n"),) for line in batch], "value string").coalesce(1)
        total += store.bulk_index(parse_json_lines(text))
    return total


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName(f"tallyrank {args.command}").getOrCreate()
    try:
        if args.command == "serve":
            server = serve(open_served(spark, args), args.interface, args.port, args.readonly)
            logging.info("serving on %s:%d", *server.server_address[:2])
            server.serve_forever()
        elif args.command == "load":
            store = Store(spark, args.datadir)
            count = store.bulk_index(read_json_lines(spark, args.files)) if args.files else load_lines(store, sys.stdin, args.batch)
            logging.info("%d records stored in %s", count, args.datadir)
        else:
            benchmark.run_csv(spark, args.csv, args.fsdatadir, args.maxrecords, args.out)
    except KeyboardInterrupt:
        return 130
    finally:
        spark.stop()
    return 0
