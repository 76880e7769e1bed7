"""Line windows and the lines around matches. Nothing here writes to what it reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linequarry.operators.lines import chomped, line_array
from linequarry.operators.search import hits, scanned
from linequarry.plans.expression import Plan


class InspectError(ValueError):
    """The bounds contradict each other or ask for nothing definite."""


@dataclass(frozen=True)
class Bounds:
    start_line: int
    end_line: int | None
    skip: int
    limit: int | None
    allow_full: bool

    def cut(self, lines: Column) -> Column:
        """The part of an array of lines that lies within."""
        most = 2**31 - 1  # of an array
        ends = [] if self.limit is None else [self.start_line + self.limit - 1]
        ends += [] if self.end_line is None else [self.end_line]
        if self.start_line > most:
            return F.slice(lines, 1, 0)
        return F.slice(lines, self.start_line, min(min(ends, default=most) - self.start_line + 1, most))


def parse_range(value: str) -> tuple[int, int]:
    low, colon, high = value.partition(":")
    if not colon or not low.isdecimal() or not high.isdecimal() or not low.isascii() or not high.isascii():
        raise InspectError("a range is START:END, both positive integers")
    if int(low) == 0 or int(high) == 0:
        raise InspectError("lines of a range are greater than zero")
    if int(low) > int(high):
        raise InspectError("a range starts at or before its end")
    return int(low), int(high)


def bounds(start_line: int | None = None, end_line: int | None = None, skip: int | None = None, limit: int | None = None, total_count: int | None = None, range_: str | None = None, all_: bool = False) -> Bounds:
    """The window that the arguments describe, or InspectError."""
    rest = [skip, limit, start_line, end_line]
    if range_ is not None:
        if total_count is not None or any(x is not None for x in rest) or all_:
            raise InspectError("a range stands alone")
        start_line, end_line = parse_range(range_)
    elif total_count is not None:
        if any(x is not None for x in rest) or all_:
            raise InspectError("a total count stands alone")
        limit = total_count
    if start_line == 0 or end_line == 0:
        raise InspectError("line numbers are greater than zero")
    if skip and start_line is not None:
        raise InspectError("give skip or a start line, not both")
    start = start_line if start_line is not None else (skip or 0) + 1
    if end_line is not None and start > end_line:
        raise InspectError(f"the range is inverted: {start} is after {end_line}")
    if end_line is None and limit is None and not all_:
        raise InspectError("give a limit, total count, end line or range, or ask for all")
    return Bounds(start, end_line, skip or 0, limit, all_)


def reject_mutation(replace: str | None = None, write: bool = False, in_place: bool = False) -> None:
    if replace is not None or write or in_place:
        raise InspectError("inspection is read-only")


def inspected(text: str) -> Column:
    """The lines of a file as inspection reads them: a "\\r" goes only as part of "\\r\\n", and binary files are read too."""
    return line_array(F.col(text), "\r?\n")


def inspected_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line, text of all lines of inspected()."""
    return files.select(*keys, F.posexplode(inspected(text)).alias("__i", "text")).select(*keys, (F.col("__i") + 1).cast("long").alias("line"), "text")


def window(files: DataFrame, keys: list[str], text: str = "text", **asked) -> DataFrame:
    """keys, line, text of each file's lines within bounds(); none beyond its end. The array is cut before it becomes rows."""
    b = bounds(**asked)
    parts = files.select(*keys, F.posexplode(b.cut(inspected(text))).alias("__i", "text"))
    return parts.select(*keys, (F.col("__i") + F.lit(b.start_line).cast("long")).alias("line"), "text")


def window_reports(files: DataFrame, keys: list[str], text: str = "text", **asked) -> DataFrame:
    """A row per file, made in the file's own row: keys, requested, total_emitted_lines, lines."""
    b = bounds(**asked)
    first = F.lit(b.start_line).cast("long")
    rows = F.transform(b.cut(inspected(text)), lambda x, i: F.struct((i + first).alias("line"), x.alias("text")))
    rows = F.coalesce(rows, F.array().cast("array<struct<line:bigint,text:string>>"))
    requested = F.struct(*[F.lit(getattr(b, k)).cast("boolean" if k == "allow_full" else "long").alias(k) for k in ("start_line", "end_line", "skip", "limit", "allow_full")])
    return files.select(*keys, requested.alias("requested"), rows.alias("lines")).select(*keys, "requested", F.size("lines").cast("long").alias("total_emitted_lines"), "lines")


def around(before: int | None, after: int | None, context: int | None) -> tuple[int, int]:
    pick = lambda x: x if x is not None else context or 0
    return pick(before), pick(after)


def with_hits(files: DataFrame, keys: list[str], plan: Plan, text: str = "text", max_hits: int | None = None) -> DataFrame:
    """keys, __lines, __at: the lines of each file that may have hits, and the numbers of its hits in order.

    Only a cap on all hits needs more than the file's own row: then at most max_hits rows name the files, and their places, by a join.
    """
    gate = plan.prefilter(F.col(text))
    own = (scanned(files, text) if gate is None else scanned(files, text).where(gate)).select(*keys, line_array(F.col(text)).alias("__lines"))
    if max_hits is None:
        at = F.transform("__lines", lambda x, i: F.when(plan.predicate(chomped(x)), i + 1))
        return own.select(*keys, "__lines", F.filter(at, lambda i: i.isNotNull()).alias("__at"))
    found = hits(files, keys, plan, text, max_hits=max_hits)
    return own.join(found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("line").cast("int"))).alias("__at")), keys)


def context(files: DataFrame, keys: list[str], plan: Plan, text: str = "text", context: int | None = None, before: int | None = None, after: int | None = None, max_hits: int | None = None) -> DataFrame:
    """keys, line, role (match or context), text: each line within reach of a match, once. A cap on hits applies first."""
    b, a = around(before, after, context)
    df = with_hits(files, keys, plan, text, max_hits)
    reach = lambda x: F.sequence(F.greatest(x - b, F.lit(1)), F.least(x + a, F.size("__lines")))
    near = F.flatten(F.transform("__at", lambda x: F.transform(reach(x), lambda i: F.struct(i.alias("line"), (i != x).alias("context")))))
    df = df.select(*keys, "__lines", F.sort_array(near).alias("__near"))
    # Of a line's entries the first says whether it is a match itself.
    once = F.filter("__near", lambda e, i: (i == 0) | (F.get(F.col("__near"), i - 1)["line"] != e["line"]))
    role = lambda e: F.when(e["context"], "context").otherwise("match")
    line = lambda e: plan.shown(chomped(F.element_at("__lines", e["line"])))
    rows = F.transform(once, lambda e: F.struct(e["line"].cast("long").alias("line"), role(e).alias("role"), line(e).alias("text")))
    return df.select(*keys, F.explode(rows).alias("__row")).select(*keys, "__row.*")


def context_in_row(files: DataFrame, keys: list[str], plan: Plan, text: str = "text", context_: int | None = None, before: int | None = None, after: int | None = None) -> DataFrame:
    """context() without a cap, which is all made in each file's row."""
    return context(files, keys, plan, text, context_, before, after)


def coalesced(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_line, end_line: overlapping and adjacent ranges made one."""
    order = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    far = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("start_line") > far + 1) | far.isNull()
    island = F.sum(F.col("__new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("__new", fresh).withColumn("__island", island).groupBy(*keys, "__island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("__island")


def context_ranges(files: DataFrame, keys: list[str], plan: Plan, text: str = "text", before: int = 0, after: int = 0) -> DataFrame:
    """The coalesced ranges of lines that context() reads: as coalesced(), in each file's row."""
    df = with_hits(files, keys, plan, text).select(*keys, "__at")
    gap = lambda x, y: y - before > x + after + 1
    begins = F.filter("__at", lambda x, i: F.coalesce(gap(F.get(F.col("__at"), i - 1), x), F.lit(True)))
    ends = F.filter("__at", lambda x, i: F.coalesce(gap(x, F.get(F.col("__at"), i + 1)), F.lit(True)))
    both = F.zip_with(begins, ends, lambda x, y: F.struct(F.greatest(x - before, F.lit(1)).cast("long").alias("start_line"), (y + after).cast("long").alias("end_line")))
    return df.select(*keys, F.explode(both).alias("__r")).select(*keys, "__r.*")


def context_reports(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per file: keys and its lines in order."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", "role", "text"))).alias("lines"))
