import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linequarry.llm import mixing as mx
from linequarry.llm import url_filters as uf

# --- mixing


def corpus(docs, sizes, null=None):
    rows, i = [], 0
    for s, n in sizes.items():
        for k in range(n):
            rows.append((i, " ".join(["w"] * (1 + k % 7)), "en", s))
            i += 1
    return docs(rows + (null or []))


def entropy(weights):
    return -sum(x * math.log(x) for x in weights if x)


@pytest.mark.parametrize("on_driver", [100_000, 0])
def test_weights_reach_the_target(docs, monkeypatch, on_driver):
    monkeypatch.setattr(mx, "DRIVER_SOURCES", on_driver)
    monkeypatch.setattr(mx, "HALVINGS", 40)
    ids = corpus(docs, {"a": 900, "b": 90, "c": 9}).select("doc_id", "source", mx.n_tokens().alias("tokens"))
    w, fit = mx.weighted(ids, entropy_part=0.8, max_repeats=1e9)
    p = [r.weight for r in w.collect()]
    assert abs(sum(p) - 1) < 1e-9 and 0 < fit.alpha < 1 and fit.met
    assert abs(entropy(p) - 0.8 * math.log(3)) < 1e-6
    if not on_driver:
        return
    w, fit = mx.weighted(ids, entropy_part=1.0, max_repeats=3.0)
    assert max(r.quota / r.tokens for r in w.collect()) <= 3.01 and min(r.quota / r.tokens for r in w.collect()) >= 1
    assert abs(max(r.quota / r.tokens for r in w.collect()) - 3) < 0.02 and not fit.met and fit.entropy < fit.target
    w, fit = mx.weighted(ids, entropy_part=0.0, max_repeats=1e9, entropy_gain=0.25)
    shares = [r.share for r in w.collect()]
    assert abs(fit.entropy - (entropy(shares) + 0.25 * (math.log(3) - entropy(shares)))) < 1e-6
    assert mx.weighted(ids, entropy_part=0.0, entropy_gain=0.0)[1].alpha == 1


def test_a_budget_keeps_weights_and_repetitions(docs):
    ids = corpus(docs, {"a": 900, "b": 90, "c": 9}).select("doc_id", "source", mx.n_tokens().alias("tokens"))
    total = ids.agg(F.sum("tokens")).head()[0]
    for budget in (total // 4, total, int(1.9 * total)):
        rows = mx.weighted(ids, entropy_part=1.0, max_repeats=2.0, budget=budget)[0].collect()
        assert abs(sum(r.quota for r in rows) - budget) <= len(rows)
        assert all(abs(r.quota - budget * r.weight) <= 1 and r.quota <= 2 * r.tokens + 1 for r in rows)
    with pytest.raises(ValueError, match="repetitions"):
        mx.weighted(ids, max_repeats=2.0, budget=2 * total + 1)


def chained(seed, *values):
    """Spark's xxhash64 of ints (4 bytes), longs given as (value,) and strings, each hash the seed of the next."""
    import xxhash

    h = 42
    for v in (seed, *values):
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h) if data is not None else h
    return h - (1 << 64) if h >> 63 else h


def mixed_brute(rows, quotas, n_blocks, seed=mx.SEED):
    """(doc_id, source, tokens, epoch) of a plain walk through each source's epochs, block by block."""
    out = []
    for s, quota in quotas.items():
        own = [(i, n) for i, of, n in rows if of == s]
        total, before, epoch = sum(n for _, n in own), 0, 0
        while epoch == 0 or before < quota:
            blocks = {}
            for i, n in own:
                blocks.setdefault(chained(seed, str(i)) % n_blocks[s], []).append((chained(seed, epoch, str(i)), i, n))
            for b in sorted(blocks, key=lambda b: (chained(seed, epoch, (b,)), b)):
                for _, i, n in sorted(blocks[b]):
                    if before < quota or (epoch == 0 and quota >= total):
                        out.append((i, s, n, epoch))
                    before += n
            epoch += 1
            if not total:
                break
    return Counter(out)


@pytest.mark.parametrize("budget", [None, 700])
def test_copies_against_a_plain_walk(docs, monkeypatch, budget):
    monkeypatch.setattr(mx, "BLOCK_TOKENS", 40)
    ids = corpus(docs, {"a": 500, "b": 70, "c": 12}).select("doc_id", "source", mx.n_tokens().alias("tokens"))
    of = {r.source: r for r in mx.weighted(ids, budget=budget)[0].collect()}
    want = mixed_brute([tuple(r) for r in ids.collect()], {s: r.quota for s, r in of.items()}, {s: r.n_blocks for s, r in of.items()})
    assert Counter((r.doc_id, r.source, r.tokens, r.epoch) for r in mx.mixed(ids, ["doc_id"], budget=budget).collect()) == want


def test_query_against_a_plain_walk(spark, sf):
    """The registered query mixes: rare sources repeat, and every copy is where the walk has it."""
    ids = mx.table(spark, sf, "documents").select("doc_id", "source", mx.n_tokens().alias("tokens"))
    of = {r.source: r for r in mx.weighted(ids)[0].collect()}
    want = mixed_brute([tuple(r) for r in ids.collect()], {s: r.quota for s, r in of.items()}, {s: r.n_blocks for s, r in of.items()})
    got = Counter((r.doc_id, r.source, r.tokens, r.epoch) for r in mx.op2_mixing(spark, sf).collect())
    assert got == want and sum(got.values()) > len(set(ids.collect()))


def test_extra_columns_of_any_name(docs):
    names = ["row", "of_id", "of_source", "of_text", "times", "nth", "digest", "tokens", "block", "epoch", "quota", "__source", "a.b"]
    df = corpus(docs, {"a": 50, "b": 5}).select("doc_id", "text", "source", *[F.lit("own").alias(n) for n in names])
    out = mx.mixed_documents(df).collect()
    assert len(out) > 55 and all(r["a.b"] == r["row"] == r["times"] == "own" for r in out)


def test_very_long_text(docs):
    assert mx.mixed_documents(docs([(1, "w " * 500_000, "en", "a"), (2, "w", "en", "b")])).count() >= 2


def test_copies_realise_the_quotas(docs):
    ids = corpus(docs, {"a": 600, "b": 60, None: 30}).select("doc_id", "source", mx.n_tokens().alias("tokens"))
    quota = {r.source: r for r in mx.weighted(ids)[0].collect()}
    out = mx.mixed(ids, ["doc_id"]).collect()
    got = Counter()
    for r in out:
        got[r.source] += r.tokens
    for s, n in got.items():
        assert quota[s].quota <= n < quota[s].quota + 7
    copies = Counter(r.doc_id for r in out)
    assert set(copies) == {r.doc_id for r in ids.collect()} and max(copies.values()) <= 2
    again = mx.mixed(ids.repartition(3), ["doc_id"]).collect()
    assert Counter((r.doc_id, r.epoch, r.block_place, r.place) for r in out) == Counter((r.doc_id, r.epoch, r.block_place, r.place) for r in again)


def test_budget_cuts_within_blocks(docs, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK_TOKENS", 50)
    ids = corpus(docs, {"a": 600, "b": 60}).select("doc_id", "source", mx.n_tokens().alias("tokens"))
    w = {r.source: r.quota for r in mx.weighted(ids, budget=800)[0].collect()}
    assert 790 <= sum(w.values()) <= 800
    got = {r.source: r.n for r in mx.mixed(ids, ["doc_id"], budget=800).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    assert all(w[s] <= got[s] < w[s] + 7 for s in w)


def test_mixed_documents(docs):
    df = corpus(docs, {"a": 300, "b": 20}, [(9000, None, "en", "a"), (None, "w w", "en", "b"), (9001, "w w", "en", "b"), (9001, "w w", "en", "b"), (9002, "", None, None)])
    out = mx.mixed_documents(df)
    assert out.columns == df.columns
    a, b = Counter((r.doc_id, r.text, r.source) for r in df.collect()), Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert all(b[k] >= n for k, n in a.items()) and set(a) == set(b) and sum(b.values()) > sum(a.values())
    few = mx.mixed_documents(df, budget=200)
    assert 0 < few.count() < df.count()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b", "en", "s")], [(1, "", "en", "s"), (2, None, "en", "t")]])
def test_small_corpora(docs, rows):
    assert mx.mixed_documents(docs(rows)).count() == len(rows)


# --- URL filters

LOG = [
    ("l", "bad.org", "block", "add", "2024-01-10"), ("l", "bad.org", "block", "remove", "2024-02-01"), ("l", "bad.org", "block", "add", "2024-03-01"), ("l", "bad.org", "block", "add", "2024-03-05"),
    ("l", "Host.net/Dir/sub", "block", "add", "2024-01-01"), ("ok", "good.bad.org", "allow", "add", "2024-01-15"), ("m", "bad.org", "allow", "add", "2024-01-10"), ("l", "gone.org", "block", "remove", "2024-01-01"),
    ("l", "both.org", "block", "add", "2024-01-01"), ("l", "both.org", "block", "remove", "2024-01-01"), ("l", None, "block", "add", "2024-01-01"),
]


@pytest.mark.parametrize(
    ("url", "day", "verdict", "pattern", "active"),
    [
        ("http://bad.org/x", "2024-01-09", "none", None, 0), ("http://bad.org/x", "2024-01-10", "block", "bad.org", 2), ("http://www.BAD.org", "2024-01-31", "block", "bad.org", 2), ("http://bad.org", "2024-02-01", "allow", "bad.org", 1),
        ("https://u:p@good.bad.org:8080/?q", "2024-04-01", "allow", "good.bad.org", 3), ("http://notbad.org", "2024-04-01", "none", None, 0), ("http://host.net/dir/sub/x?y", "2024-04-01", "block", "host.net/dir/sub", 1),
        ("http://host.net/dir/subway", "2024-04-01", "none", None, 0), ("http://gone.org", "2024-04-01", "none", None, 0), ("http://both.org", "2024-04-01", "none", None, 0), (None, "2024-04-01", "none", None, 0), ("nonsense", "2024-04-01", "none", None, 0),
        ("http://bad.org", None, "none", None, 0), ("", "2024-04-01", "none", None, 0),
    ],
)
def test_verdicts(spark, url, day, verdict, pattern, active):
    at = dt.datetime.fromisoformat(day) if day else None
    df = spark.createDataFrame([(1, url, at, "x")] * 2, "page_id long, url string, fetched_at timestamp, key string")
    rows = uf.judged(df, uf.entries(spark, LOG)).collect()
    assert [(r.verdict, r.pattern, r.n_active, r.key) for r in rows] == [(verdict, pattern, active, "x")] * 2


def test_intervals(spark):
    got = {r.pattern: [(v.valid_from.date().isoformat(), v.valid_to and v.valid_to.date().isoformat(), v["list"]) for v in r.valid] for r in uf.intervals(uf.entries(spark, LOG)).collect()}
    assert got["bad.org"] == [("2024-01-10", None, "m"), ("2024-01-10", "2024-02-01", "l"), ("2024-03-01", None, "l")]
    assert "gone.org" not in got and "both.org" not in got


def test_empty_lists_and_tables(spark):
    none = spark.createDataFrame([], "list string, pattern string, effect string, action string, at timestamp")
    pages = spark.createDataFrame([("http://a.b/c", dt.datetime(2024, 1, 1))], "url string, fetched_at timestamp")
    assert uf.judged(pages, none).head().verdict == "none"
    assert uf.judged(pages.limit(0), uf.entries(spark)).count() == 0


def test_hosts_and_long_urls(spark):
    log = [("l", "bad.org/a", "block", "add", "2024-01-01"), ("l", "[2001:db8::1]", "block", "add", "2024-01-01"), ("l", "3.4", "block", "add", "2024-01-01"), ("l", "1.2.3.4", "block", "add", "2024-01-01")]
    at = dt.datetime(2024, 2, 1)
    urls = ["http://bad.org/" + "a/" * 50_000, "http://bad.org/" + "b/" * 50_000, "http://" + "x." * 20_000 + "bad.org/a", "http://[2001:DB8::1]:80/x", "http://1.2.3.4/x", "http://9.2.3.4/x"]
    df = spark.createDataFrame([(u, at) for u in urls], "url string, fetched_at timestamp")
    got = {r.url: r.verdict for r in uf.judged(df, uf.entries(spark, log)).collect()}
    assert [got[u] for u in urls] == ["block", "none", "none", "block", "block", "none"]


def test_any_extra_column(spark):
    """Every name that the operator uses itself, as a column of the captures."""
    names = ["n", "b", "row", "key", "v", "valid", "at_url", "at_time", "action", "effect", "at", "__url", "a.b", "host", "verdict", "list", "pattern", "valid_from", "valid_to", "n_active"]
    df = spark.createDataFrame([("http://bad.org", dt.datetime(2024, 1, 20), *["own"] * len(names))], ["url", "fetched_at", *names])
    out = uf.judged(df, uf.entries(spark, LOG))
    r = out.head().asDict()
    assert (r["host"], r["verdict"], r["pattern"], r["n_active"]) == ("bad.org", "block", "bad.org", 2)
    assert all(r[c] == "own" for c in names[:13]) and len(out.columns) == 22
