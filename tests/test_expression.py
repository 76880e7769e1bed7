import re

import pytest
from pyspark.sql import functions as F

from linequarry.functions import byte_regex as rx
from linequarry.plans.expression import ExpressionError, parse

PATTERNS = [
    r"\w+\s+the\s+\w+", r"\bla\b", r"\Bn\b", r"^a.c$", r"[^a-c]+", r"(?i)straße", r"(ab|a)(c|bcd)", r"x{2,3}?", r"\d{2,}-\d+", r"[[:upper:]][[:lower:]]*",
    r"(?P<y>\d+)", r"a|b|", r"(?s)a.b", r"(?m)^b", r"é+", r"\x41|\x{42}", r"[\w.]+@[\w.]+", r"[]a-]+", r"(?i:ab)c", r"\.", r"a*?b", r"(a|aa)", r"\S+", r"[^\x00-\x7f]{2}",
]
LINES = ["", "the", "see the cat the dog", "xlay la élan", "abc abcd a\x85c", "STRASSE straße STRAßE", "xxxxx 12-3 123-45", "Ab aB ABc abc", "a.b@c.de, né", "aa\tb éé ü", "]-a[", "a\x0bb", " x A"]


def python_pattern(p):
    for name in rx.POSIX:
        p = p.replace(f"[:{name}:]", {"upper": "A-Z", "lower": "a-z"}.get(name, ""))
    return re.compile(p.replace(r"\x{42}", "B").replace("é+", "(?:é)+").encode())


@pytest.mark.parametrize("pattern", PATTERNS)
def test_regex_agrees_with_bytes(spark, pattern):
    """Match, byte column and non-overlapping count against Python's re on bytes."""
    plan, own = parse("re:" + pattern), python_pattern(pattern)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, x string")
    p = plan.single
    got = {r.i: r for r in df.select("i", p.matches(F.col("x")).alias("m"), p.column(F.col("x")).alias("c"), p.occurrences(F.col("x")).alias("n")).collect()}
    for i, x in enumerate(LINES):
        b = x.encode()
        m = own.search(b)
        assert got[i].m == bool(m), (pattern, x)
        assert got[i].c == (m.start() + 1 if m else None), (pattern, x)
        if not rx.nullable(rx.parse(pattern)):
            assert got[i].n == len(own.findall(b)), (pattern, x)


def test_empty_matches_after_a_match_dont_count(spark):
    df = spark.createDataFrame([("baac",), ("",), ("aaa",)], "x string")
    assert [r[0] for r in df.select(parse("re:a*").single.occurrences(F.col("x"))).collect()] == [3, 1, 1]


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<=a)b", "(?<!a)b", r"(a)\1", r"\p{L}", "(?>a)", "(", ")", "a**b(", "[z-a]", "[é]", "*a", r"a{2,1}", r"\k", "{", "a|{2}", "a{1,200000}", "(a{1000}){1000}", r"(?u)\w", r"(?u)[a]", r"(?u)\b", "(?iu)é", "(?-u).", r"(?-u)\xff", "(?-u)[^a]", r"(?-u)\W", r"\b{middle}"])
def test_regex_refused(pattern):
    with pytest.raises(ExpressionError):
        parse("re:" + pattern)


@pytest.mark.parametrize(
    ("pattern", "members"),
    [("[a-z&&[^b-y]]", "az"), ("[a-e--b-d]", "ae"), ("[a-c~~b-d]", "ad"), ("[a-z&&aeiou--u]", "aeio"), (r"[\w--\d_&&[:lower:]]", "abcdefghijklmnopqrstuvwxyz"), ("[^\\x00-\\xff]", ""), ("[a&&b]", ""), ("[--b]", "-b"), ("(?i)[a-c--B]", "ACac")],
)
def test_class_operations(pattern, members):
    assert "".join(sorted(map(chr, rx.parse(pattern).members))) == members


@pytest.mark.parametrize(
    ("pattern", "line", "found"),
    [
        (r"\b{start}\w", "ab cd", [0, 3]), (r"\w\b{end}", "ab cd", [1, 4]), (r"\<c", "cc c", [0, 3]), (r"c\>", "cc c", [1, 3]), (r"\b{start-half}b", "ab b-b", [3, 5]), (r"b\b{end-half}", "ba ab", [4]),
        ("(?mR)^a", "a\r\na\ra\na", [0, 3, 5, 7]), ("(?mR)a$", "a\r\na\ra\na", [0, 3, 5, 7]), ("(?mR)^", "\r\n", [0, 2]), ("(?R)a.", "a\rab", [2]), ("(?u)x.y", "xéy x\ny", [0]), ("(?iu)k", "\u212a k", [0, 4]), ("(?-u)a", "ba", [1]), (r"\b{2}a", "ba a", [3]),
    ],
)
def test_dialect(spark, pattern, line, found):
    """Places of all matches, by a search of every suffix that keeps what stands before it."""
    p = parse("re:" + pattern).single
    row = spark.range(1).select(p.column(F.lit(line)).alias("c"), p.occurrences(F.lit(line)).alias("n")).head()
    assert (row.c, row.n) == (found[0] + 1, len(found))


def test_bytes_needn_t_be_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff\xfeneedle \xc3\xa9nd"),)], "b binary").select(F.decode("b", "ISO-8859-1").alias("x"))
    at = lambda e: df.select(parse(e).on_bytes().column(F.col("x")).alias("c"), parse(e).on_bytes().predicate(F.col("x")).alias("m")).head()
    assert [tuple(at(e)) for e in (r"re:\xff", "needle", "lit:é", r"re:\w+\s+é", "suffix:énd", "re:(?i)NEEDLE", "prefix:a", "re:é")] == [(2, True), (4, True), (11, True), (4, True), (11, True), (4, True), (1, True), (11, True)]
    count = lambda e: df.select(parse(e).on_bytes().single.occurrences(F.col("x"))).head()[0]
    assert [count(e) for e in ("lit:é", r"re:[^\x00-\x7f]", "lit:n", "re:(?i)É")] == [1, 4, 2, 0]


def test_grammar():
    p = parse("  a && b || c ")
    assert (p.mode, [x.value for x in p.predicates]) == ("any", ["a && b", "c"])
    assert [(x.kind, x.value) for x in parse("re:x && prefix:y && suffix:z && lit:w && v").predicates] == [("regex", "x"), ("prefix", "y"), ("suffix", "z"), ("literal", "w"), ("literal", "v")]
    assert parse("a||").mode == "any"
    assert [x.value for x in parse("re:").predicates] == [""]
    for bad in ("", "  ", "||", "&&", "lit:", "prefix:", "suffix:", "a || suffix:"):
        with pytest.raises(ExpressionError):
            parse(bad)


@pytest.mark.parametrize(
    ("expr", "strategy"),
    [
        ("re:abc", "plain_literal"), ("re:(?i)abc", "case_fold_literal"), ("re:(?i)для", "unicode_case_fold_literal"), (r"re:\babc\b", "word_bounded_literal"), (r"re:(?i)\babc\b", "case_fold_word_bounded_literal"),
        ("re:(abc|ab)", "literal_alternation"), ("re:(?i)(abc|ab)", "case_fold_literal_alternation"), (r"re:\w+\s+Holmes\s+\w+", "decomposed"), (r"re:\w{5}", "generic"), ("re:(abcd|abce)x?", "generic"),
        ("re:(a|é)", "generic"), ("lit:a", "literal"), ("prefix:a", "prefix"), ("suffix:a", "suffix"), (r"re:(?i)ß", "generic"),
    ],
)
def test_recogniser(expr, strategy):
    assert parse(expr).single.strategy == strategy


def test_required_literal():
    of = lambda p: rx.required_literal(rx.parse(p))
    assert of(r"\w+Sherlock\s+Ho") == b"Sherlock"
    assert of("ab|ab") == b"ab"
    assert of("ab|ac") is None
    assert of("(abc)?de") == b"de"
    assert of("(?i)abc") is None
    assert of("(abc){2}x") == b"abc"


def test_word_bounds_of_odd_literals(spark):
    """A literal between \\b that begins with a non-word byte asks for no word byte on either side."""
    df = spark.createDataFrame([("a -foo",), ("a-foo",), ("needles xneedle needle _needle",)], "x string")
    assert [r[0] for r in df.select(parse(r"re:\b-foo\b").predicate(F.col("x"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(parse(r"re:\bneedle\b").single.occurrences(F.col("x"))).collect()] == [0, 0, 1]


def test_ordered_alternation(spark):
    df = spark.createDataFrame([("ab abc abcab",), ("aa",)], "x string")
    assert df.select(parse("re:(abc|ab)").single.occurrences(F.col("x"))).head()[0] == 4
    assert df.select(parse("re:(a|aa)").single.occurrences(F.col("x"))).collect()[1][0] == 2


def test_explain():
    e = parse("lit:a || re:b+").explain()
    assert e["mode"] == "any"
    assert e["predicates"] == [{"type": "literal", "value": "a"}, {"type": "regex", "value": "b+"}]
