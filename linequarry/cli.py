"""Command line: search, matches, inspect, explain, or a grep-like request."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from linequarry import api
from linequarry.functions import render
from linequarry.operators import inspect as ins
from linequarry.plans.compat import CompatError, lower_grep
from linequarry.plans.expression import parse
from linequarry.sources.files import byte_text, discover, files, found_files

VERBS = ("search", "matches", "inspect", "explain")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linequarry")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("search", "matches"):
        v = verbs.add_parser(verb)
        v.add_argument("expr")
        v.add_argument("paths", nargs="*", default=["."])
        v.add_argument("--stats-only", action="store_true")
        v.add_argument("--max-hits", type=int)
        v.add_argument("-j", "--threads", type=int, help="accepted; parallelism is the session's")
        v.add_argument("--emit-report")
        for flag in ("--hidden", "--follow-symlinks", "--json"):
            v.add_argument(flag, action="store_true")
    v = verbs.add_parser("inspect")
    v.add_argument("paths", nargs="+")
    v.add_argument("--expr")
    v.add_argument("--range", dest="range_")
    for flag in ("--start-line", "--end-line", "--skip", "--limit", "--max-hits"):
        v.add_argument(flag, type=int)
    v.add_argument("--total-count", "--head", type=int)
    v.add_argument("-C", "--context", type=int)
    v.add_argument("-B", "--before-context", type=int)
    v.add_argument("-A", "--after-context", type=int)
    v.add_argument("--replace")
    for flag in ("--all", "--hidden", "--follow-symlinks", "--json", "--write", "--in-place"):
        v.add_argument(flag, action="store_true")
    v = verbs.add_parser("explain")
    v.add_argument("expr")
    return p


def route(argv: list[str]) -> argparse.Namespace:
    """A known verb's arguments, or a grep-like request as those of search."""
    if argv and (argv[0] in VERBS or argv[0] in ("-h", "--help")):
        return parser().parse_args(argv)
    r = lower_grep(argv)
    return argparse.Namespace(verb="search", expr=r.expression, paths=r.paths, stats_only=False, max_hits=None, emit_report=None, hidden=r.hidden, follow_symlinks=False, json=r.json)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    say = lambda x: print(x, file=out)
    try:
        args = route(sys.argv[1:] if argv is None else argv)
        if args.verb == "explain":
            say(parse(args.expr).explain_json())
            return 0
        if args.verb == "inspect":
            ins.reject_mutation(args.replace, args.write, args.in_place)
        plan = parse(args.expr) if args.expr else None
        spark = spark or SparkSession.builder.getOrCreate()
        if args.verb == "inspect":
            return inspect(spark, args, plan, say, lambda head, name, rows: (out.writelines(render.report_parts(head, name, rows, {})), say("")))
        report = api.search(spark, api.Config(args.expr, args.paths, args.hidden, args.follow_symlinks, args.max_hits, not args.stats_only, args.threads if "threads" in args else None))
        parts = lambda indent: render.report_parts({"expression": report.expression}, "hits", report.hits, {"stats": report.stats}, indent)
        if args.emit_report:
            os.makedirs(os.path.dirname(os.path.abspath(args.emit_report)), exist_ok=True)
            with open(args.emit_report, "w", encoding="utf-8") as f:
                f.writelines(parts(True))
        if args.json:
            out.writelines(parts(False))
            say("")
            return 0
        if report.hits is not None:
            for r in render.hit_text(report.hits).toLocalIterator():
                say(r.rendered)
        if args.verb == "search":
            for line in render.summary(report.expression, report.stats):
                say(line)
        return 0
    except (ValueError, CompatError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def inspect(spark: SparkSession, args: argparse.Namespace, plan, say, write_parts) -> int:
    window = {"range_": args.range_, "start_line": args.start_line, "end_line": args.end_line, "skip": args.skip, "limit": args.limit, "total_count": args.total_count}
    context = {"context": args.context, "before": args.before_context, "after": args.after_context}
    if plan is None:
        if any(x is not None for x in context.values()):
            raise ins.InspectError("match context needs an expression")
        ins.bounds(**window, all_=args.all)
        missing = [p for p in args.paths if not os.access(p, os.R_OK) or not os.path.isfile(p)]
        if missing:
            raise ins.InspectError(f"can't read {missing[0]}")
        frame = files(spark, args.paths)
        bad = frame.where("NOT is_valid_utf8(CAST(content AS STRING))").select("path").head()
        if bad:
            raise ins.InspectError(f"{bad.path} is not valid UTF-8")
        frame = frame.selectExpr("path", "CAST(content AS STRING) AS text")
        if args.json:
            write_parts({}, "reports", ins.window_reports(frame, ["path"], **window, all_=args.all).orderBy("path"))
            return 0
        for r in render.window_text(ins.window(frame, ["path"], **window, all_=args.all).orderBy("path", "line")).toLocalIterator():
            say(r.rendered)
        return 0
    if any(x is not None for x in window.values()) or args.all:
        raise ins.InspectError("an expression takes context, not window bounds")
    frame = byte_text(found_files(spark, discover(args.paths, args.hidden, args.follow_symlinks))).select("path", "text")
    rows = ins.context(frame, ["path"], plan.on_bytes(), **context, max_hits=args.max_hits)
    if args.json:
        write_parts({"expression": plan.source}, "reports", ins.context_reports(rows, ["path"]).orderBy("path"))
        return 0
    for r in render.context_text(rows.orderBy("path", "line")).toLocalIterator():
        say(r.rendered)
    return 0


if __name__ == "__main__":
    sys.exit(main())
