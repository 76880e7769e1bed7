import re

import pytest

from linequarry.operators import probes

TEXTS = {"a": "é ERR_SYS x", "b": "ERR_SYSERR_SYS\nCFG_BME_EVT", "c": "", "d": None, "e": "PME_TURN_OFF" * 50, "f": "ab\nERR_SYS\0"}
SEARCHED = [t for k, t in TEXTS.items() if t is not None and k != "f"]


def got(df):
    return {r.variant: r for r in df.collect()}


def test_alternation(files):
    r = got(probes.alternation(files(TEXTS), list(probes.LITERALS), (1, 3, 16)))
    want = sum(len(re.findall("|".join(probes.LITERALS), t)) for t in SEARCHED)
    assert set(r) == {"whole", "gated", "lines", "literal_sum", "ranges_1", "ranges_3", "ranges_16"}
    assert all(x.n_occurrences == want and x.comparable for x in r.values())
    assert r["whole"].read_chars == r["ranges_1"].read_chars == sum(map(len, SEARCHED))
    longest = max(map(len, probes.LITERALS))
    assert r["ranges_3"].read_chars == sum(len(t) + sum(min(longest - 1, len(t) - (k * len(t)) // 3) for k in (1, 2, 3)) for t in SEARCHED)


def test_nested_and_overlapping_literals(files):
    df = files({"a": "there the th", "b": "aaaaaaaa"})
    assert got(probes.alternation(df, ["there", "the", "th"]))["literal_sum"].n_occurrences == 6
    r = got(probes.alternation(df, ["there", "the", "th"]))
    assert not r["literal_sum"].comparable and all(x.n_occurrences == 3 for w, x in r.items() if w != "literal_sum")
    # A literal that can begin inside itself is found anew behind a range's edge.
    r = got(probes.alternation(df, ["aaa"], (2,)))
    assert (r["whole"].n_occurrences, r["ranges_2"].n_occurrences, r["ranges_2"].comparable) == (2, 3, False)


def test_literals_beyond_ascii_and_with_signs(files):
    r = got(probes.alternation(files({"a": "é.é x.y xzy ü", "b": "é"}), ["é", "x.y"]))
    assert {x.n_occurrences for x in r.values()} == {4}


def test_no_literal(files):
    words = "abcde fghij\tklmno pqrst uvwxy zabcd efghi"
    df = files({"a": f"{words} {words}", "b": "abcde", "c": "", "d": None, "e": f"é {words}"})
    assert {r.variant: r.n for r in probes.no_literal(df).collect()} == {"all": 3, "first_then_rest": 3, "test_then_all": 3, "test": 2}
    assert {r.variant: r.n for r in probes.no_literal(df, "x*").collect() if r.variant != "test"}.keys() == {"all", "first_then_rest", "test_then_all"}


def test_empty_corpus_and_times(files):
    none = files({"a": "x"}).where("path = 'b'")
    assert {r.n_occurrences for r in probes.alternation(none, ["a", "b"]).collect()} == {0}
    assert {r.n for r in probes.no_literal(none).collect()} == {0}
    t = probes.timed(files({"a": "x y"}), probes.no_literal_ways("[xy]"), samples=2)
    assert {w: v["count"] for w, v in t.items()} == {"all": 2, "first_then_rest": 2, "test_then_all": 2, "test": 1}
    assert all(v["median_ms"] > 0 for v in t.values())
    with pytest.raises(ValueError):
        probes.timed(none, {}, samples=0)
