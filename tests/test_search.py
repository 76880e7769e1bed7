import pytest
from pyspark.sql import functions as F

from linequarry.operators import inspect as ins
from linequarry.operators import lines as ln
from linequarry.operators import search as se
from linequarry.plans.expression import parse

KEY = ["path"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_lines(files):
    df = files({"empty": "", "end": "a\nb\n", "blank": "\n\nx", "cr": "a\r\nneedle\r", "two": "x\r\r\n", "nul": "a\0b\nneedle", "late": "x" * 1024 + "\0\nneedle"})
    got = {}
    for p, i, t in rows(ln.lines(df, KEY), "path", "line", "text"):
        got.setdefault(p, []).append(t if len(t) < 100 else "long")
    assert got == {"end": ["a", "b"], "blank": ["", "", "x"], "cr": ["a", "needle"], "two": ["x\r"], "late": ["long", "needle"]}


def test_nul_probe_is_in_bytes(files):
    df = files({"in": "é" * 511 + "x\0", "out": "é" * 512 + "\0"})
    assert rows(se.scanned(df), "path") == [("out",)]


def test_hits(files):
    df = files({"a": "x\né needle needle\nneedle", "b": "none"})
    assert rows(se.hits(df, KEY, parse("needle")), "path", "line", "column", "preview") == [("a", 2, 4, "é needle needle"), ("a", 3, 1, "needle")]


def test_columns(files):
    df = files({"a": "zz pre mid suf"})
    at = lambda e: se.hits(df, KEY, parse(e)).head()["column"]
    assert (at("suffix:suf"), at("prefix:zz"), at("mid && pre"), at("mid || suffix:suf"), at("re:p.e")) == (12, 1, 4, 8, 4)


def test_conjunction_is_on_one_line(files):
    df = files({"a": "x\ny", "b": "x y"})
    assert rows(se.hits(df, KEY, parse("x && y")), "path") == [("b",)]
    assert rows(se.hits(df, KEY, parse("x || y")), "path", "line") == [("a", 1), ("a", 2), ("b", 1)]


def test_suffix_sees_the_line_without_cr(files):
    df = files({"a": "a\r\nneedle\r"})
    assert rows(se.hits(df, KEY, parse("suffix:needle")), "line", "column") == [(2, 1)]


def test_preview(files):
    line = "𝄞" * 300
    assert se.hits(files({"a": line}), KEY, parse("𝄞")).head()["preview"] == line[:220]


def test_cap(files):
    df = files([("b", "n\nn\nn"), ("a", "xx n\nn\nn\nn")])
    assert [tuple(r)[:3] for r in se.hits(df, KEY, parse("n"), max_hits=2).collect()] == [("a", 1, 4), ("a", 2, 1)]
    assert se.hits(df, KEY, parse("n"), max_hits=0).count() == 0
    assert se.run_stats(df, KEY, parse("n")).head()["matches_found"] == 7
    assert rows(se.hits(df, KEY, parse("n"), per_file=1), "path", "line") == [("a", 1), ("b", 1)]


def test_partitions_dont_matter(files):
    df = files({f"p{i}": "the\n" * (i % 5) + "other" for i in range(40)})
    a = rows(se.hits(df.repartition(7), KEY, parse("the")), "path", "line")
    assert a == rows(se.hits(df.coalesce(1), KEY, parse("the")), "path", "line")
    assert len(a) == se.count_lines(df, KEY, parse("the")).agg(F.sum("n_lines")).head()[0]


@pytest.mark.parametrize(
    ("expr", "lines", "stats"),
    [("aa", 2, 3), ("re:aa", 2, 3), ("re:(?i)AA", 2, 3), (r"re:\baa\b", 1, 2), ("re:(aa|b)", 2, 4), (r"re:a+\s+a+", 1, 1), ("prefix:aa", 2, 2), ("suffix:a", 1, 1), ("a && b", 1, 1), ("re:b$", 1, 1)],
)
def test_two_ways_to_count(files, expr, lines, stats):
    """Lines with hits, occurrences or lines without, as the predicate's class has it."""
    df = files({"f": "aa aa\naab"})
    assert se.matches_found(df, KEY, parse(expr), collect_hits=True).head()["n_matches"] == lines
    assert se.matches_found(df, KEY, parse(expr)).head()["n_matches"] == stats


def test_anchors_are_the_files_without_hits(files):
    df = files({"f": "b\nb\nab"})
    assert se.matches_found(df, KEY, parse("re:^b"), collect_hits=True).head()["n_matches"] == 2
    assert se.matches_found(df, KEY, parse("re:^b")).head()["n_matches"] == 1
    assert se.matches_found(df, KEY, parse(r"re:b\s+b")).head()["n_matches"] == 1


def test_decomposition(files):
    plan = parse(r"re:\w+\s+Holmes\s+\w+")
    d = se.decomposition(files({"f": "see Holmes run Holmes now\na Holmes b\nHolmes"}), KEY, plan).head()
    assert (d.candidate_lines, d.duplicates_skipped, d.matched_lines, d.bailed_out) == (2, 1, 2, False)
    many = files({"f": "a Holmes b\n" * 5000})
    s = se.decomposition_stats(many, KEY, plan).head()
    assert (s.eligible, s.bailed, s.candidate_lines) == (1, 1, 4096)
    assert se.matches_found(many, KEY, plan).head()["n_matches"] == 5000


def test_unicode_casefold(files):
    d = se.unicode_casefold_count(files({"f": "Шерлок Холмс\nШЕРЛОК ХОЛМС\nШерлок Холм"}), KEY, parse("re:(?i)Шерлок Холмс")).head()
    assert (d.n_occurrences, d.prefix_hits, d.rejected) == (2, 3, 1)


def test_stats(files):
    r = se.run_stats(files({"a": "é the", "b": "\0the", "c": ""}), KEY, parse("the")).head()
    assert (r.files_discovered, r.files_scanned, r.files_skipped, r.bytes_scanned, r.matches_found) == (3, 2, 1, 6, 1)


def test_empty_corpus(files):
    df = files([])
    assert se.hits(df, KEY, parse("a")).count() == 0
    assert se.run_stats(df, KEY, parse("a")).head()["matches_found"] == 0


def test_loop_summary(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3, 9)], "ms double")
    r = se.loop_summary(df).head()
    assert (r.loops, r["min"], r.mean, r.p95, r.median, r["max"]) == (6, 1.0, 4.0, 9.0, 4.0, 9.0)


def seconds(run):
    import time

    best = 1e9
    for _ in range(3):
        began = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - began)
    return best


def test_one_large_file_takes_time_in_proportion(spark):
    """Hits, a window and context of one file: twice the lines, at most three times the time."""
    took = {}
    for n in (50_000, 100_000):
        df = spark.createDataFrame([("f", "\n".join(f"line {i} of the file" for i in range(n)))], "path string, text string").cache()
        df.count()
        plan = parse("lit:5 of")
        for name, run in {
            "hits": lambda df=df: se.hits(df, KEY, plan).count(),
            "window": lambda df=df: ins.window(df, KEY, all_=True).count(),
            "context": lambda df=df: ins.context(df, KEY, plan, context=2).count(),
            "ranges": lambda df=df: ins.context_ranges(df, KEY, plan, before=2).count(),
        }.items():
            took.setdefault(name, []).append(seconds(run))
    assert all(b < 3 * max(a, 0.2) for a, b in took.values()), took


def test_nth_value(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 3, 3, 1, 2, 1e9, -5.5, 3.25)], "ms double")
    ordered = sorted((3, 3, 3, 1, 2, 1e9, -5.5, 3.25))
    assert [se.nth_value(df, "ms", k + 1) for k in range(8)] == ordered
    assert se.loop_summary(df.where("ms > 1e10")).count() == 0


def test_decomposition_stops_at_the_bail_out(files):
    plan = parse(r"re:\w+\s+Holmes\s+\w+")
    df = files({"many": "a Holmes b Holmes c\n" * 5000, "few": "a Holmes b Holmes c\nHolmes x\n"})
    got = {r.path: r for r in se.decomposition(df, KEY, plan).collect()}
    m, f = got["many"], got["few"]
    assert (m.candidate_lines, m.duplicates_skipped, m.matched_lines, m.bailed_out) == (4096, 4096, 4096, True)
    assert (f.candidate_lines, f.duplicates_skipped, f.matched_lines, f.bailed_out, f.n_matches) == (1, 1, 1, False, 1)
