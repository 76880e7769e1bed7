import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from linequarry.llm import exact_dedup as ex
from linequarry.llm import simhash_dedup as sh
from linequarry.llm import substring_dedup as ss
from linequarry.llm.common import table

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


# --- exact


def exact_brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", t or "").encode()).hexdigest(), []).append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for d, g in groups.items():
        best = min(g)
        out += [(x[4], best[4], len(g), x is best, d) for x in g]
    return sorted(out, key=repr)


EDGE = [(1, "a b"), (2, "ab"), (3, " a\nb "), (4, None), (5, ""), (6, "\t\n"), (None, "ab"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "z"), (9, "z"), (10, "a b"), (11, "é")]


def test_exact(docs, plain):
    assert plain(ex.exact_dedup(docs(EDGE))) == exact_brute(EDGE)
    assert plain(ex.exact_dedup(docs([]))) == []
    assert plain(ex.exact_dedup(docs([(None, None), (None, None)]))) == exact_brute([(None, None), (None, None)])


def test_exact_with_heavy_hitters(docs, plain):
    """Many digests, of which two hold most rows, so that both ways are taken."""
    rows = [(i, "hot one" if i % 3 == 0 else "hot" + " " * (i % 5) + "two" if i % 3 == 1 else f"cold {i // 6}") for i in range(4000)]
    assert plain(ex.exact_dedup(docs(rows))) == exact_brute(rows)


def test_exact_kept_rows(docs):
    df = docs([*EDGE, (9, "other"), (12, "other")])
    kept = ex.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, len(r.text)) for r in kept.collect()) == [(3, 5), (6, 2), (7, 200_000), (9, 1), (9, 5), (10, 3), (11, 1)]


# --- near


def fingerprint_brute(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components_brute(codes, ids, distance=4):
    c, up = np.array(codes, np.uint64), list(range(len(codes)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(c)):
        for j in np.flatnonzero(np.bitwise_count(c ^ c[i]) <= distance):
            a, b = sorted((root(i), root(int(j))))
            up[b] = a
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(c))]


def near_rows():
    r = random.Random(4)
    base = [prose(r, 150).split() for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three four"), (7, "ÀB àb"), (8, prose(r, 30_000)), (None, "lonely words stand here now"), (None, "one two")]
    rows += [(100 + i, " ".join(w if r.random() > 0.01 else "changed" for w in r.choice(base))) for i in range(120)]
    return rows + [(100, rows[10][1])]


def test_near(docs, plain):
    rows = near_rows()
    codes = [fingerprint_brute(t) for _, t in rows]
    want = sorted(((i, f"{c:016x}", k) for (i, _), c, k in zip(rows, codes, components_brute(codes, [i for i, _ in rows]), strict=True)), key=repr)
    assert plain(sh.near_duplicates(docs(rows))) == want
    assert len({w[2] for w in want}) < 100
    assert plain(sh.near_duplicates(docs([]))) == []


def test_near_kept_rows(docs):
    rows = near_rows()
    df = docs(rows)
    kept = sh.drop_near_copies(df)
    codes = [fingerprint_brute(t) for _, t in rows]
    roots = components_brute(codes, [i for i, _ in rows])
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    assert sorted(i for i in ids if i is not None) == sorted({k for k in roots if k is not None})


def test_near_copies_keep_a_row_of_each_component(docs):
    """Ids that repeat with unrelated texts, and several clean rows without an id."""
    r = random.Random(12)
    a, b, c, d, *clean = (prose(r, 150) for _ in range(9))
    rows = [(7, a), (7, b), (3, c), (7, c), (9, d), (9, d), (None, d), *[(None, t) for t in clean], (None, clean[0]), (None, None), (None, ""), (5, clean[4])]
    df = docs(rows)
    kept = sh.drop_near_copies(df)
    assert kept.columns == df.columns
    want = [(7, a), (7, b), (3, c), (9, d), *[(None, t) for t in clean[:4]], (None, ""), (5, clean[4])]
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(x.text for x in sh.drop_near_copies(docs([(None, a), (None, b)])).collect()) == sorted([a, b])
    assert sh.drop_near_copies(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << r.integers(0, 64, (3, 400), dtype=np.uint64), axis=0)
    a = np.unique(np.concatenate([r.choice(base, 400) ^ flips, r.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    one = sh.GrayIndex(a, fan=4)
    assert np.array_equal(np.sort(one.codes), a)
    brute = {frozenset((int(p), int(q))) for p in a for q in a[np.bitwise_count(a ^ p) <= 4] if p != q}
    assert {frozenset((int(one.codes[x]), int(one.codes[y]))) for i, j in one.links(4, most=256) for x, y in zip(i, j, strict=True)} == brute


def test_upper_nodes_prune():
    """Of a full top node's pairs upper nodes prune nearly all that aren't near."""
    r = np.random.default_rng(2)
    codes = np.unique(r.integers(0, 1 << 51, sh.FULL, dtype=np.uint64))
    index = sh.GrayIndex(codes)
    list(index.links(4))
    assert index.met < 0.05 * len(codes) * (len(codes) - 1) / 2


def skewed(r, n):
    """Codes around few centres, all alike in their upper half, and some that differ in few places."""
    some = np.uint64(0xABCDEF01) << np.uint64(32) | r.integers(0, 1 << 32, 6, dtype=np.uint64).repeat(n)
    for _ in range(3):
        some = some ^ (np.uint64(1) << r.integers(0, 64, len(some), dtype=np.uint64))
    return np.unique(np.concatenate([some, np.uint64(7) << np.uint64(50) | r.integers(0, 1 << 9, n, dtype=np.uint64)]))


@pytest.mark.parametrize(("expected", "tops"), [(512, 5), (0, 70)])
def test_full_nodes_are_split(spark, expected, tops):
    """With at most 16 members a node, in 5 or 70 top nodes a code, the same components come out."""
    codes = skewed(np.random.default_rng(9), 60)
    assert len(sh.top_masks(len(codes), expected=expected)) == tops
    df = spark.createDataFrame([(int(c.view(np.int64)),) for c in codes], "code long").coalesce(2)
    found = {r.node: r.root for r in sh.components(sh.link_edges(df, full=16, expected=expected)).collect()}
    signed = [int(c.view(np.int64)) for c in codes]
    assert [found.get(c, c) for c in signed] == components_brute(codes, signed)


def test_nodes_of_a_fingerprint_are_bounded():
    """What one fingerprint costs grows by choices of blocks, not with the number of all."""
    assert [len(sh.top_masks(n)) for n in (0, 10**5, 10**6, 10**7, 10**8, 10**9, 10**10, 10**12)] == [5, 5, 5, 15, 15, 35, 35, 70]
    for n in (10, 10**7, 10**10):
        masks = sh.top_masks(n)
        r = random.Random(n)
        for _ in range(300):
            flips = sum(1 << i for i in r.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in sh.components(edges).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[1000] == found[1001] == 1000


# --- repeated strings


def strings_brute(rows, n=ss.LENGTH):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + n] for b in texts for k in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(bool(g) and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_strings(docs, plain):
    r = random.Random(3)
    rnd = lambda n: "".join(r.choice("abé ") for _ in range(n))
    p, q = rnd(700), rnd(260)
    rows = [
        (1, None), (2, ""), (3, p), (4, p[100:420] + rnd(50)), (5, rnd(80) + p[300:560] + rnd(30)), (6, "ab" * 400), (7, q + rnd(100) + q), (7, q + "x"), (8, p), (8, p), (None, p[50:300]),
        (9, rnd(3000)), (10, "z" * 199), (11, "z" * 199), (12, "y" * 200), (13, p[:150] + "#" + p[151:]), (14, rnd(20) + q[:199] + "!" + rnd(300)), (15, "w" * 5000), (16, rnd(600)[:0] + " " * 900),
    ]
    assert plain(ss.substring_dedup(docs(rows))) == strings_brute(rows)
    assert plain(ss.substring_dedup(docs([]))) == []


def test_repeated_strings_between_edited_copies(docs, plain):
    """A hot group: copies with an edit each, whose nodes stay open to the last round."""
    r = random.Random(8)
    base = prose(r, 120)
    rows = [(i, base[: (k := r.randint(0, len(base)))] + r.choice(["#", "", "zz"]) + base[k:]) for i in range(60)] + [(100 + i, prose(r, 60)) for i in range(40)]
    assert plain(ss.substring_dedup(docs(rows))) == strings_brute(rows)


def test_repeats_of_long_texts(docs, plain):
    """Texts beyond CHUNK, with strings repeated across its bounds and in other texts."""
    r = random.Random(11)
    rnd = lambda n: "".join(r.choices("abcdefgh ", k=n))
    p, q = rnd(3000), rnd(450)
    one = rnd(ss.CHUNK - 1500) + p + rnd(5000) + q + rnd(20)
    rows = [(1, one), (2, rnd(100) + p[200:2600] + rnd(100)), (3, q[5:300]), (4, rnd(300)), (None, None)]
    assert plain(ss.substring_dedup(docs(rows))) == strings_brute(rows)


def test_texts_of_one_id_and_one_crc(docs, plain):
    """Different texts with the same id and CRC-32 are not cut at each other's places."""
    r = random.Random(5)
    p, a, b, seen = prose(r, 60), prose(r, 50), prose(r, 50), {}
    heads, tails = (lambda k: f"{p} {a} {k}"), (lambda k: f"{b} {k}")
    some = lambda n: (f"{r.getrandbits(64):016x}" for _ in range(n))
    for k in some(1 << 18):
        seen[zlib.crc32(heads(k).encode())] = k
    k = next(k for k in some(1 << 22) if zlib.crc32(tails(k).encode()) in seen)
    one, two = heads(seen[zlib.crc32(tails(k).encode())]), tails(k)
    rows = [(None, one), (None, two), (1, p)]
    assert plain(ss.substring_dedup(docs(rows))) == strings_brute(rows)


def test_repeated_strings_of_the_tables(spark, sf, plain):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert plain(ss.op8_suffix_array_dedup(spark, sf)) == strings_brute(rows)


def test_stretches_cover_long_texts(monkeypatch):
    monkeypatch.setattr(ss, "CHUNK", 1000)
    ss.powers.cache_clear()
    r = random.Random(1)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 150, 999, 5000, 300)]
    starts = {k: [] for k in range(5)}
    for which, begin, parts in ss.stretches(texts):
        data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
        s1, s2, _ = ss.anchors(data, ends)
        at = np.searchsorted(ends, s1, side="right")
        first = np.concatenate(([0], ends[:-1]))
        for a, b, k in zip(s1, s2, at, strict=True):
            starts[which[k]] += range(int(a - first[k] + begin[k]), int(b - first[k] + begin[k]) + 1)
    ss.powers.cache_clear()
    assert {k: sorted(v) for k, v in starts.items()} == {k: list(range(max(0, len(t) - 199))) for k, t in enumerate(texts)}


def test_queries(spark, sf, plain):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    codes = [fingerprint_brute(t) for _, t in rows]
    want = [(i, f"{c:016x}", k) for (i, _), c, k in zip(rows, codes, components_brute(codes, [i for i, _ in rows]), strict=True)]
    assert plain(sh.op6_simhash_dedup(spark, sf)) == sorted(want, key=repr)
    assert plain(ex.op10_exact_dedup(spark, sf)) == exact_brute(rows)
