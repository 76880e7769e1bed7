import pytest

from linequarry import api
from linequarry.operators.inspect import InspectError


@pytest.fixture
def root(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"one needle\ntwo\nneedle needle")
    (tmp_path / "d/b.bin").write_bytes(b"\0needle")
    (tmp_path / "d/c.txt").write_bytes(b"")
    return str(tmp_path)


def test_search(spark, root):
    r = api.search(spark, api.Config("lit:needle", [root, f"{root}/d", f"{root}/d/a.txt"]))
    assert [(h.line, h.column) for h in r.hits.collect()] == [(1, 5), (3, 1)]
    s = r.stats
    assert (s["input_roots"], s["effective_roots"], s["pruned_roots"], s["overlap_pruned_roots"]) == (3, 1, 2, 2)
    assert (s["files_discovered"], s["files_scanned"], s["files_skipped"], s["matches_found"], s["bytes_scanned"]) == (3, 2, 1, 2, 28)
    assert api.search(spark, api.Config("lit:needle", [root], max_hits=1)).hits.count() == 1
    only = api.search(spark, api.Config("lit:needle", [root], collect_hits=False))
    assert only.hits is None and only.stats["matches_found"] == 3


def test_prepared(spark, root):
    p = api.prepare(spark, api.Config("x", [root]))
    assert api.search_prepared(api.Config("needle", [root]), p).stats["matches_found"] == 2
    assert api.search_prepared(api.Config("two", [root]), p).stats["matches_found"] == 1
    with pytest.raises(ValueError):
        api.search_prepared(api.Config("two", [root], hidden=True), p)


def test_counts(files):
    df = files({"f": "aa aa\nb"})
    assert [api.count(df, ["path"], api.parse("aa"), m).head()[1] for m in ("lines", "occurrences", "matches")] == [1, 2, 2]
    with pytest.raises(ValueError):
        api.count(df, ["path"], api.parse("aa"), "x")


def test_window(spark, root):
    r = api.inspect_window(spark, [f"{root}/d/a.txt"], range_="2:2").head()
    assert r.total_emitted_lines == 1 and r.lines[0].text == "two"
    with pytest.raises(InspectError):
        api.inspect_window(spark, [f"{root}/none"], all_=True)
    assert api.explain("a || b")["mode"] == "any"


def test_files_that_arent_utf8(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"ab\xff\xfe needle\r\n\xffend\n")
    r = api.search(spark, api.Config(r"re:\xfe.needle || re:^\xffe", [str(tmp_path)]))
    assert [(h.line, h.column, h.preview) for h in r.hits.collect()] == [(1, 4, "ab\ufffd\ufffd needle"), (2, 1, "\ufffdend")]
    assert r.stats["bytes_scanned"] == 18 and r.stats["matches_found"] == 2
    assert {"discover_ms", "scan_ms", "aggregate_ms", "total_ms"} == set(r.stats["timings"])


def test_counters_of_a_count(spark, tmp_path):
    (tmp_path / "many").write_text("a Holmes b\n" * 5000)
    (tmp_path / "few").write_text("a Holmes b Holmes c\n")
    s = api.search(spark, api.Config(r"re:\w+\s+Holmes\s+\w+", [str(tmp_path)], collect_hits=False)).stats
    assert s["acceleration_bailouts"] == 1 and s["matches_found"] == 5001
    assert s["regex_decomposition"] == {"eligible_files": 2, "counted_files": 1, "bailout_files": 1, "candidate_lines_checked": 4097, "duplicate_candidate_hits_skipped": 1, "candidate_lines_matched": 4097}
    (tmp_path / "u").write_text("Für für f")
    s = api.search(spark, api.Config("re:(?i)für", [str(tmp_path / "u")], collect_hits=False)).stats
    assert s["unicode_casefold_prefilter"] == {"candidate_prefix_hits": 3, "confirmed_matches": 2, "rejected_candidates": 1}


def test_uris(spark, root):
    r = api.search(spark, api.Config("lit:needle", [f"file://{root}/d"]))
    assert [(h.line, h.column) for h in r.hits.collect()] == [(1, 5), (3, 1)]
    assert (r.stats["effective_roots"], r.stats["files_scanned"], r.stats["matches_found"]) == (1, r.stats["files_discovered"] - 1, 2)
