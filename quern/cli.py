"""Command line: slice, filter and add up logfmt logs with Spark.

    python -m quern.cli app.log --if 'level>=warn' --from start+1h --count --group-by svc
"""

from __future__ import annotations

import argparse
import os
import sys

from .functions.rows import humanized
from .plans.durations import SpecError
from .plans.filters import FilterError
from .plans.query import Query, QueryError, parse_edits


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description="Slice, filter and count logfmt logs with Spark.")
    p.add_argument("files", nargs="*", metavar="FILE", help="inputs in order; - is standard input")
    p.add_argument("--if", "--where", dest="where", action="append", default=[], metavar="EXPR", help="filter; several are joined by and")
    p.add_argument("--from", dest="time_from", metavar="T")
    p.add_argument("--to", dest="time_to", metavar="T")
    p.add_argument("--window-secs", type=int, default=10, help="grace before a streamed bucket closes")
    p.add_argument("--time-range", action="store_true", help="print the span of all lines")
    p.add_argument("--count", action="store_true")
    p.add_argument("--group-by", default="", metavar="K[,K]")
    p.add_argument("--bucket", metavar="DURATION")
    p.add_argument("--n-buckets", type=int, metavar="N")
    p.add_argument("--fill", action="store_true", help="print empty buckets of --n-buckets too")
    p.add_argument("--list-keys", action="store_true")
    p.add_argument("--list-values-for", default="", metavar="K[,K]")
    p.add_argument("--raw-key", metavar="K")
    p.add_argument("--sort-by", metavar="K")
    p.add_argument("-n", "--limit", type=int)
    p.add_argument("-A", dest="after", type=int)
    p.add_argument("-B", dest="before", type=int)
    p.add_argument("-C", dest="context", type=int)
    p.add_argument("--sample-rate", type=float)
    p.add_argument("--sample-if", metavar="EXPR")
    p.add_argument("--seed", type=int)
    p.add_argument("--rm", action="append", default=[], metavar="K[,K]")
    p.add_argument("--add", action="append", default=[], metavar="K=V[,K=V]")
    p.add_argument("--json", action="store_true")
    p.add_argument("--color", choices=("auto", "always", "never"), default=os.environ.get("COLOR", "auto"))
    p.add_argument("--tz", default="UTC")
    p.add_argument("-f", dest="follow", action="store_true", help="go on reading the last file")
    p.add_argument("-F", dest="reopen", action="store_true", help="as -f, also when the file is replaced")
    p.add_argument("-j", dest="parallel", type=int, nargs="?", const=0, default=1)
    p.add_argument("-o", dest="output", metavar="FILE")
    p.add_argument("--stats", action="store_true", help="print what was read to standard error")
    p.add_argument("--master", default=None, help="Spark master; by default the one of spark-submit, or local[*]")
    return p


def _split(text: str) -> tuple[str, ...]:
    return tuple(k for k in text.split(",") if k)


def query_of(a: argparse.Namespace, terminal: bool = False) -> Query:
    remove, add = parse_edits(a.rm, a.add)
    color = a.color == "always" or a.color == "auto" and terminal and not a.json and a.output is None
    return Query(
        where=tuple(a.where), time_from=a.time_from, time_to=a.time_to, count=a.count, group_by=_split(a.group_by), bucket=a.bucket, n_buckets=a.n_buckets,
        list_keys=a.list_keys, list_values=_split(a.list_values_for), time_range=a.time_range, raw_key=a.raw_key, sort_by=a.sort_by, limit=a.limit,
        after=a.after, before=a.before, context=a.context, sample_rate=a.sample_rate, sample_if=a.sample_if, seed=a.seed, add=add, remove=remove,
        json=a.json, color=color, zone=a.tz, follow=a.follow, reopen=a.reopen, window_secs=a.window_secs, parallel=a.parallel or os.cpu_count() or 1, fill=a.fill,
    )


def session(master: str | None = None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    if master or "SPARK_MASTER" not in os.environ and not SparkSession.getActiveSession():
        builder = builder.master(master or "local[*]")
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        query = query_of(args, sys.stdout.isatty())
        query.check_inputs(args.files)
    except (QueryError, FilterError, SpecError) as e:
        print(f"quern: {e}", file=sys.stderr)
        return 2
    from .plans.planner import Engine

    spark = session(args.master)
    spark.sparkContext.setLogLevel("ERROR")
    if query.parallel > 1:
        spark.conf.set("spark.sql.files.minPartitionNum", query.parallel)
    stdin = (line.removesuffix("\n") for line in sys.stdin) if not args.files or "-" in args.files else None
    to = open(args.output, "w", encoding="utf-8", newline="") if args.output else sys.stdout  # noqa: SIM115
    try:
        if query.follows:
            from .streaming.tail import follow

            follow(spark, args.files, query, lambda line: print(line, file=to, flush=True))
            return 0
        if args.files in ([], ["-"]) and not args.stats:
            from .streaming.tail import can_listen, listen

            if can_listen(query):
                listen(spark, stdin, query, lambda line: print(line, file=to, flush=True))
                return 0
        engine = Engine(spark, args.files, stdin)
        for part in engine.output(query):
            for row in part.toLocalIterator():
                print(row["line"], file=to)
        if args.stats:
            s = engine.statistics(query)
            print(f"read {humanized(s['bytes'])}, {s['lines']} lines, {s['matched']} matched, {s['invalid_utf8']} not UTF-8, {s['pairs']} pairs, {s['overflow']} lines over the pair limit", file=sys.stderr)
    except (QueryError, FilterError, SpecError) as e:
        print(f"quern: {e}", file=sys.stderr)
        return 2
    finally:
        if to is not sys.stdout:
            to.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
