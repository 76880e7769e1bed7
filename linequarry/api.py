"""The library's front door: search and inspect files on disk, or frames of files."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linequarry.operators import inspect as ins
from linequarry.operators import search as se
from linequarry.operators.inspect import context, window
from linequarry.plans.expression import Plan, parse
from linequarry.sources.files import Discovered, Prepared, byte_text, depth, discover, files, found_files

__all__ = ["Config", "Plan", "Report", "context", "count", "explain", "inspect_window", "parse", "prepare", "search", "search_prepared", "window"]

KEYS = ["path"]


@dataclass
class Config:
    """What to search for, and where. threads is accepted and means nothing: parallelism is the session's."""

    expression: str
    roots: list[str] = field(default_factory=lambda: ["."])
    hidden: bool = False
    follow_symlinks: bool = False
    max_hits: int | None = None
    collect_hits: bool = True
    threads: int | None = None


@dataclass
class Report:
    """hits is ordered and capped, or None for a count without hits; stats are the run's counters and the driver's times."""

    expression: str
    hits: DataFrame | None
    stats: dict


def prepare(spark: SparkSession, config: Config) -> Prepared:
    """Files discovered once, for any number of searches with the same roots and options."""
    return Prepared(spark, config.roots, config.hidden, config.follow_symlinks)


def counters(frame: DataFrame, plan: Plan) -> dict:
    """What a count without hits tells of its one predicate's acceleration; empty for other predicates."""
    p = plan.single
    if p and p.strategy == "decomposed":
        d = se.decomposition_stats(frame, KEYS, plan).head()
        own = {"eligible_files": d.eligible, "counted_files": d.counted, "bailout_files": d.bailed, "candidate_lines_checked": d.candidate_lines, "duplicate_candidate_hits_skipped": d.duplicates_skipped, "candidate_lines_matched": d.matched_lines}
        return {"acceleration_bailouts": d.bailed, "regex_decomposition": own}
    if p and p.strategy == "unicode_case_fold_literal":
        u = se.unicode_casefold_count(frame, KEYS, plan).agg(F.sum("prefix_hits").alias("a"), F.sum("n_occurrences").alias("b"), F.sum("rejected").alias("c")).head()
        return {"unicode_casefold_prefilter": {"candidate_prefix_hits": u.a or 0, "confirmed_matches": u.b or 0, "rejected_candidates": u.c or 0}}
    return {}


def report(config: Config, found: Discovered, frame: DataFrame, discover_ms: float) -> Report:
    """Statistics are taken now; hits when the frame is read. Lines are searched as bytes, valid UTF-8 or not."""
    plan, began = parse(config.expression).on_bytes(), time.perf_counter()
    text = byte_text(frame).select("path", "text")
    counted = se.run_stats(text, KEYS, plan, collect_hits=config.collect_hits).head().asDict()
    more = {} if config.collect_hits else counters(text, plan)
    scan_ms, began = 1000 * (time.perf_counter() - began), time.perf_counter()
    sizes = frame.select("path", "length")
    read = sizes.agg(F.count("*").alias("n"), F.max(depth(F.col("path"))).cast("long").alias("max_depth")).head()
    largest = byte_text(frame).select("path", F.col("length").alias("bytes")).orderBy(F.desc("bytes"), "path").limit(5).collect()
    roots, aggregate_ms = found.roots, 1000 * (time.perf_counter() - began)
    n = len(found.paths) if not found.uris else read.n
    stats = {
        "input_roots": roots.input_roots, "effective_roots": roots.effective_roots, "pruned_roots": roots.pruned_roots, "overlap_pruned_roots": roots.overlap_pruned_roots, "duplicate_paths": found.duplicate_paths,
        "acceleration_bailouts": 0, "files_discovered": n, "files_scanned": counted["files_scanned"], "files_skipped": n - counted["files_scanned"], "files_unreadable": n - read.n,
        "bytes_scanned": counted["bytes_scanned"], "matches_found": counted["matches_found"], "max_depth": read.max_depth or 0, "largest_files": [r.asDict() for r in largest],
        "concurrency": {"partitions": frame.rdd.getNumPartitions(), "slots": frame.sparkSession.sparkContext.defaultParallelism},
        "timings": {"discover_ms": round(discover_ms, 3), "scan_ms": round(scan_ms, 3), "aggregate_ms": round(aggregate_ms, 3), "total_ms": round(discover_ms + scan_ms + aggregate_ms, 3)},
    } | more
    hits = None
    if config.collect_hits:
        hits = se.hits(text, KEYS, plan, max_hits=config.max_hits)
        hits = hits if config.max_hits is not None else hits.orderBy(*KEYS, "line", "column")
    return Report(plan.source, hits, stats)


def search(spark: SparkSession, config: Config) -> Report:
    parse(config.expression)  # a bad expression fails before any file is touched
    began = time.perf_counter()
    found = discover(config.roots, config.hidden, config.follow_symlinks)
    ms = 1000 * (time.perf_counter() - began)
    return report(config, found, found_files(spark, found), ms)


def search_prepared(config: Config, prepared: Prepared) -> Report:
    """As search(), over prepared files; ValueError if they were prepared for other roots or options. Discovery takes no time."""
    return report(config, prepared.found, prepared.for_search(config.roots, config.hidden, config.follow_symlinks), 0.0)


def count(frame: DataFrame, keys: list[str], plan: Plan, mode: str = "lines", text: str = "text") -> DataFrame:
    """lines, occurrences, or matches (what a search without hits reports)."""
    if mode == "lines":
        return se.count_lines(frame, keys, plan, text)
    if mode == "occurrences":
        return se.count_occurrences(frame, keys, plan, text)
    if mode == "matches":
        return se.matches_found(frame, keys, plan, text)
    raise ValueError(f"unknown mode {mode!r}")


def inspect_window(spark: SparkSession, paths: list[str], **asked) -> DataFrame:
    """A report for each file; an unreadable or invalid file is an error when the frame is built."""
    ins.bounds(**asked)
    frame = files(spark, paths)
    if (n := frame.count()) < len(paths):
        raise ins.InspectError(f"{len(paths) - n} of the files can't be read")
    if bad := frame.where("NOT is_valid_utf8(CAST(content AS STRING))").select("path").head():
        raise ins.InspectError(f"{bad.path} is not valid UTF-8")
    return ins.window_reports(frame.selectExpr("path", "CAST(content AS STRING) AS text"), KEYS, **asked)


def explain(expression: str) -> dict:
    return parse(expression).explain()
