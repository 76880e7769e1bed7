"""Hits and counts.

A hit is a matching line: keys, line, column (1-based byte place of its earliest match),
preview (its first 220 characters). Lines and occurrences are counted by two operators;
matches_found() picks between them as a search without hits does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linequarry.functions import byte_regex as rx
from linequarry.operators.lines import chomped, line_array, lines, text_is_binary
from linequarry.plans.expression import LEAST_LITERAL, Plan

PREVIEW, BAIL_OUT = 220, 4096


def hit_columns(plan: Plan, text: str = "text") -> list[Column]:
    line = F.col(text)
    return [plan.column(line).alias("column"), F.substring(plan.shown(line), 1, PREVIEW).alias("preview")]


def hits(files: DataFrame, keys: list[str], plan: Plan, text: str = "text", max_hits: int | None = None, per_file: int | None = None) -> DataFrame:
    """keys, line, column, preview of matching lines. max_hits: the first by keys, line and column; per_file: the first of each file."""
    gate = plan.prefilter(F.col(text))
    if per_file is None:
        found = lines(files, keys, text, where=gate).where(plan.predicate(F.col("text")))
    else:  # a file is one row, which can cap its own hits
        own = F.transform(line_array(F.col(text)), lambda x, i: F.struct((i + 1).cast("long").alias("line"), chomped(x).alias("text")))
        first = F.slice(F.filter(own, lambda s: plan.predicate(s["text"])), 1, per_file)
        found = (scanned(files, text) if gate is None else scanned(files, text).where(gate)).select(*keys, F.explode(first).alias("__hit")).select(*keys, "__hit.*")
    found = found.select(*keys, "line", *hit_columns(plan))
    return found if max_hits is None else found.orderBy(*keys, "line", "column").limit(max_hits)


def scanned(files: DataFrame, text: str = "text") -> DataFrame:
    """The files that a search reads: those that aren't binary."""
    return files.where(~text_is_binary(F.col(text)))


def count_lines(files: DataFrame, keys: list[str], plan: Plan, text: str = "text") -> DataFrame:
    """keys, n_lines: of every scanned file, in its own row and without a shuffle."""
    matching = F.filter(line_array(F.col(text)), lambda x: plan.predicate(chomped(x)))
    n = F.size(matching).cast("long")
    gate = plan.prefilter(F.col(text))
    return scanned(files, text).select(*keys, (n if gate is None else F.when(gate, n).otherwise(F.lit(0).cast("long"))).alias("n_lines"))


def count_occurrences(files: DataFrame, keys: list[str], plan: Plan, text: str = "text", scope: str = "file") -> DataFrame:
    """keys, n_occurrences of a single predicate, by file: over the whole text, or summed over its lines."""
    p = plan.single
    if p is None:
        raise ValueError("occurrences are counted for one predicate")
    if scope == "file":
        return scanned(files, text).select(*keys, p.occurrences(F.col(text)).alias("n_occurrences"))
    own = lines(files, keys, text)
    return own.groupBy(*keys).agg(F.sum(p.occurrences(F.col("text"))).alias("n_occurrences"))


def unicode_casefold_count(files: DataFrame, keys: list[str], plan: Plan, text: str = "text") -> DataFrame:
    """keys, n_occurrences of a case-folded non-ASCII literal by Unicode case mapping, and the counters of its prefilter: characters case-equal to its first, and those without a match."""
    p = plan.single
    first = p.core[0]
    near = F.regexp_count(plan.shown(F.col(text)), F.lit(f"(?iu){first}")).cast("long")
    n = p.unicode_occurrences(F.col(text))
    return scanned(files, text).select(*keys, n.alias("n_occurrences"), near.alias("prefix_hits"), F.greatest(near - n, F.lit(0)).alias("rejected"))


def matches_found(files: DataFrame, keys: list[str], plan: Plan, text: str = "text", collect_hits: bool = False) -> DataFrame:
    """keys, n_matches as a search reports it: lines when it collects hits, else what its one predicate's class counts."""
    p, as_matches = plan.single, lambda df, c: df.select(*keys, F.col(c).alias("n_matches"))
    if collect_hits or p is None or p.kind in ("prefix", "suffix"):
        return as_matches(count_lines(files, keys, plan, text), "n_lines")
    if p.strategy == "unicode_case_fold_literal":
        return as_matches(unicode_casefold_count(files, keys, plan, text), "n_occurrences")
    if p.strategy == "decomposed":
        return decomposition(files, keys, plan, text).select(*keys, "n_matches")
    return as_matches(count_occurrences(files, keys, plan, text), "n_occurrences")


def decomposition(files: DataFrame, keys: list[str], plan: Plan, text: str = "text") -> DataFrame:
    """Of each file, for a regular expression with a required literal: candidate_lines (that hold it, in its context if that is known),
    duplicates_skipped (further such places on a candidate line), matched_lines, bailed_out, n_matches.

    Beyond BAIL_OUT candidates a file bails out: the counters stop there, and its occurrences are counted in place of its lines.
    """
    p = plan.single
    literal = p and p.kind == "regex" and rx.required_literal(rx.parse(p.value))
    if not literal or len(literal) < LEAST_LITERAL:
        raise ValueError("the predicate has no required literal")
    left, right = rx.literal_context(rx.parse(p.value), literal) or ("", "")
    # The literal comes first, so that what stands around it is only looked at where it is.
    own = rx.to_java(rx.Literal(literal))
    gate = own + (f"(?<={left}{own})" if left else "") + (f"(?={right})" if right else "")
    every = line_array(F.col(text))
    holds = p.gate(F.col(text))
    if holds is not None:  # files, then lines, without the literal are never looked at by a regular expression
        every = F.filter(F.when(holds, every).otherwise(F.array().cast("array<string>")), p.gate)
    found = F.transform(every, lambda x: F.struct(F.regexp_count(p.view(x), F.lit(gate)).cast("long").alias("n"), p.matches(chomped(x)).alias("hit")))
    df = scanned(files, text).select(*keys, F.col(text).alias("__text"), F.filter(found, lambda f: f["n"] > 0).alias("__all"))
    df = df.select(*keys, "__text", F.size("__all").cast("long").alias("__n"), F.slice("__all", 1, BAIL_OUT).alias("__some"))
    places = F.aggregate("__some", F.lit(0).cast("long"), lambda a, f: a + f["n"])
    matched = F.size(F.filter("__some", lambda f: f["hit"])).cast("long")
    df = df.select(*keys, "__text", F.size("__some").cast("long").alias("candidate_lines"), places.alias("__places"), matched.alias("matched_lines"), (F.col("__n") > BAIL_OUT).alias("bailed_out"))
    n = F.when(F.col("bailed_out"), p.occurrences(F.col("__text"))).otherwise(F.col("matched_lines"))
    return df.select(*keys, "candidate_lines", (F.col("__places") - F.col("candidate_lines")).alias("duplicates_skipped"), "matched_lines", "bailed_out", n.alias("n_matches"))


def decomposition_stats(files: DataFrame, keys: list[str], plan: Plan, text: str = "text") -> DataFrame:
    """One row: the counters of decomposition() over all files."""
    d = decomposition(files, keys, plan, text).drop("n_matches")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return d.agg(
        F.count("*").alias("eligible"), F.count_if(~F.col("bailed_out")).alias("counted"), F.count_if("bailed_out").alias("bailed"),
        total("candidate_lines"), total("duplicates_skipped"), total("matched_lines"),
    )


def run_stats(files: DataFrame, keys: list[str], plan: Plan, text: str = "text", collect_hits: bool = True) -> DataFrame:
    """One row, of one pass: files discovered, scanned and skipped, bytes scanned, matches found."""
    binary = text_is_binary(F.col(text))
    unread = F.coalesce(binary, F.lit(True))
    sized = files.select(*keys, F.when(unread, "").otherwise(F.col(text)).alias(text), binary.alias("__binary"), plan.n_bytes(F.col(text)).alias("__bytes"))
    found = matches_found(sized, [*keys, "__binary", "__bytes"], plan, text, collect_hits)
    read = ~F.col("__binary")
    total = lambda c: F.coalesce(F.sum(F.when(read, F.col(c))), F.lit(0)).cast("long")
    return found.agg(F.count("*").alias("files_discovered"), F.count_if(read).alias("files_scanned"), F.count_if("__binary").alias("files_skipped"), total("__bytes").alias("bytes_scanned"), total("n_matches").alias("matches_found"))


def largest_files(files: DataFrame, keys: list[str], text: str = "text", n: int = 5) -> DataFrame:
    """The n largest files; the stand-in for the slowest, whose times differ from run to run."""
    return files.select(*keys, F.octet_length(text).cast("long").alias("bytes")).orderBy(F.desc("bytes"), *keys).limit(n)


def nth_value(values: DataFrame, column: str, n: int) -> float:
    """The n-th smallest (from 1), by ever finer histograms of 1024 bins: no task or driver sees more rows than that."""
    held = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    low, high = held.agg(F.min("v"), F.max("v")).head()
    while low < high:
        bins = held.where(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - low) / (high - low) * 1023).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for b in sorted(bins.collect(), key=lambda b: b.bin):
            if n <= b.n:
                low, high = b.low, b.high
                break
            n -= b.n
    return low


def loop_summary(seconds: DataFrame, column: str = "ms") -> DataFrame:
    """One row (none without a value): loops, min, mean, p95 (the sorted value at floor(0.95 n), clamped), median (upper middle), max."""
    n = seconds.where(F.col(column).isNotNull()).count()
    at = lambda i: F.lit(nth_value(seconds, column, min(i, n)) if n else None).cast("double")
    s = seconds.agg(F.count(column).alias("loops"), F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"))
    return s.where("loops > 0").select("loops", "min", "mean", at(int(n * 0.95) + 1).alias("p95"), at(n // 2 + 1).alias("median"), "max")
