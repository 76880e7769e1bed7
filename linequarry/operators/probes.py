"""Probes: one count of a corpus, taken in several ways that should agree, with the time of each if asked.

alternation() counts an alternation of literals over whole texts, behind a test for any of
the literals, by lines, as a sum of single literals, and by ranges of each text. A range reads on
past its end by the longest literal less one character, and owns the matches that begin inside it.
no_literal() counts a pattern that requires no literal: all matches; the first and then those of the rest;
all behind a test; and the test alone, which counts files.

Only files that a search reads are counted (no null text, no binary file), in their own rows.
An empty corpus counts 0 everywhere.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linequarry.operators.lines import chomped, line_array
from linequarry.operators.search import scanned
from linequarry.plans.compat import escaped
from linequarry.plans.expression import parse

RANGES = (1, 2, 4, 8, 16)
#: The patterns that are probed by default.
LITERALS = ("ERR_SYS", "PME_TURN_OFF", "LINK_REQ_RST", "CFG_BME_EVT")
NO_LITERAL = r"\w{5}\s+\w{5}\s+\w{5}\s+\w{5}\s+\w{5}\s+\w{5}\s+\w{5}"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, n: a + n)


def by_ranges(view: Column, java: str, n: int, past: int) -> tuple[Column, Column]:
    """The matches that begin in each of n ranges of a text, summed, and the characters read, with up to so many past each range's end."""
    size = F.char_length(view)
    edge = lambda k: F.floor(size.cast("long") * k / n).cast("int")
    more = lambda k: F.least(F.lit(past), size - edge(k + 1))

    def owned(k: Column) -> Column:
        read = F.substring(view, edge(k) + 1, edge(k + 1) - edge(k) + more(k))
        # A match begins in the range if more characters are left there than those past its end; that is asked only where one begins.
        left = F.concat(F.lit(f"(?={java})(?=(?s:.{{"), (more(k) + 1).cast("string"), F.lit(f"}}))(?:{java})"))
        return F.regexp_count(read, left).cast("long")

    ks = F.sequence(F.lit(0), F.lit(n - 1))
    return total(F.transform(ks, owned)), size.cast("long") + total(F.transform(ks, lambda k: more(k).cast("long")))


def alternation_ways(literals: list[str], range_counts: tuple[int, ...] = RANGES, text: str = "text") -> dict[str, tuple[Column, Column]]:
    """Of each way: the matches that it counts in a text, and the characters that it reads of it."""
    t, p = F.col(text), parse("re:(" + "|".join(map(escaped, literals)) + ")").single
    view, every = p.view(t), p.occurrences(t)
    size = F.char_length(view).cast("long")
    held = F.lit(False)
    for x in literals:
        held = held | t.contains(F.lit(x))
    alone = [parse("lit:" + x).single.occurrences(t) for x in literals]
    ways = {
        "whole": (every, size),
        "gated": (F.when(held, every).otherwise(F.lit(0).cast("long")), size),
        "lines": (total(F.transform(line_array(t), lambda x: p.occurrences(chomped(x)))), size),
        "literal_sum": (sum(alone[1:], alone[0]), size * len(literals)),
    }
    # As the view has them: characters, or bytes where the literals hold others than ASCII.
    longest = max(len(x) if p.ascii else len(x.encode()) for x in literals)
    return ways | {f"ranges_{n}": by_ranges(view, p.java, n, longest - 1) for n in range_counts}


def alternation(files: DataFrame, literals: list[str], range_counts: tuple[int, ...] = RANGES, text: str = "text") -> DataFrame:
    """variant, n_occurrences, read_chars, comparable (whether it counts what `whole` does). One pass over the files."""
    ways = alternation_ways(literals, range_counts, text)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    sums = scanned(files, text).agg(*[zero(n).alias(f"n_{w}") for w, (n, _) in ways.items()], *[zero(r).alias(f"r_{w}") for w, (_, r) in ways.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("variant"), F.col(f"n_{w}").alias("n_occurrences"), F.col(f"r_{w}").alias("read_chars"), (F.col(f"n_{w}") == F.col("n_whole")).alias("comparable")) for w in ways]))
    return sums.select(rows.alias("row")).select("row.*")


def no_literal_ways(pattern: str = NO_LITERAL, text: str = "text") -> dict[str, Column]:
    """Of each way: what it counts in a text."""
    t, p = F.col(text), parse("re:" + pattern).single
    view, every = p.view(t), p.occurrences(t)
    first = F.regexp_extract(view, f"({p.java})", 1)
    rest = F.substring(view, F.regexp_instr(view, F.lit(p.java)) + F.char_length(first), F.char_length(view))
    found, none = view.rlike(p.java), F.lit(0).cast("long")
    # An empty first match leaves a rest that holds it again.
    return {
        "all": every,
        "first_then_rest": F.when(first != "", 1 + F.regexp_count(rest, F.lit(p.java)).cast("long")).when(found, every).otherwise(none),
        "test_then_all": F.when(found, every).otherwise(none),
        "test": found.cast("long"),
    }


def no_literal(files: DataFrame, pattern: str = NO_LITERAL, text: str = "text") -> DataFrame:
    """variant, n: matches, and for `test` the files with one. One pass over the files.

    first_then_rest agrees with the others where no match looks at what stands before it.
    """
    ways = no_literal_ways(pattern, text)
    sums = scanned(files, text).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(w) for w, c in ways.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(w).alias("variant"), F.col(w).alias("n")) for w in ways])).alias("row")).select("row.*")


def timed(files: DataFrame, ways: dict[str, Column], samples: int = 7, warmup: int = 1, text: str = "text") -> dict[str, dict]:
    """Of each way its count and the median of its times in ms (the upper middle one); rounds begin with another way each time."""
    if samples < 1:
        raise ValueError("at least one sample is needed")
    runs = {w: scanned(files, text).agg(F.coalesce(F.sum(c), F.lit(0)).alias("n")) for w, c in ways.items()}
    names, took, counts = list(ways), {w: [] for w in ways}, {}
    for k in range(-warmup, samples):
        for w in names[k % len(names) :] + names[: k % len(names)]:
            began = time.perf_counter()
            counts[w] = int(runs[w].head().n)
            if k >= 0:
                took[w].append(1000 * (time.perf_counter() - began))
    return {w: {"count": counts[w], "median_ms": round(sorted(took[w])[samples // 2], 3)} for w in names}
