"""Suffix-array dedup: repeated 200-byte strings by distributed prefix doubling over thinned positions.

Prefix doubling sorts all positions by pairs of ranks, (rank of the k bytes at i, rank of those at
i + k), and reranks, for k = 1, 2, 4 and so on. On every byte that moves over 20 bytes a byte, so here
positions are thinned first, and doubling starts from the strings of GRAM bytes at what is left:

1. Every window of LENGTH bytes is represented by its least-hashed GRAM-byte string, its anchor,
   which equal windows share at the same offset. Runs of windows with one anchor form a node.
   A node whose anchor is unique leaves.
2. A node whose hull, all its windows' bytes, recurs is done, all its windows repeated. Of each
   group of equal hulls one node goes on, as a witness, as long as the group of its anchor has
   nodes that aren't done.
3. What is left are open positions: for each BLOCK of a node's windows the string of SHARED bytes
   that they have in common. Round by round, pairs of ranks are sorted, counted and numbered
   anew; a position whose pair is unique leaves: 50 bytes to 100 (offset 50), 100 to 185 (offset
   85: the two halves may overlap).
4. The windows of the blocks that recur: 100 bytes to 200 (offset 100), past the threshold.

The first rank of a string is its 64-bit hash, so that no round over bytes is needed; a rank after
that is the pair's place in sorted order. The last round's pair has 128 bits of the windows' own
bytes, so no earlier collision can make a window recur.

Documents are read to find anchors, to fetch the bytes of the few open nodes, and to cut
the results out. No step needs a group's rows in one task: counts are partial aggregates and
joins are by equality with tables of groups, so that Spark can split hot ones. Rows are told
apart by doc_id and the text's 64-bit xxHash.

Defined cases: a null text is empty: 0 bytes, nothing removed, the SHA-256 of nothing. Texts
under LENGTH bytes keep all. Repeated rows are copies of each other, so all of their bytes
go if there are LENGTH or more. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linequarry.functions.shipping import ship
from linequarry.llm.common import forget, table, text_or_empty, written

LENGTH, GRAM, BLOCK = 200, 50, 16
#: What all windows of a block share, and the length that the first round of doubling reaches.
SHARED, HALF = LENGTH - BLOCK + 1, 2 * GRAM
#: Bytes looked at together; longer documents are cut into stretches of windows, which changes nodes but no result.
CHUNK = 1 << 20
KEY = ["doc_id", "digest"]


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and the powers of an odd number and of its inverse modulo 2**64."""
    random = np.random.default_rng(20240229)
    base = int(random.integers(0, 1 << 62)) * 2 + 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(CHUNK + LENGTH + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return random.integers(0, 1 << 64, 256, dtype=np.uint64), *out


def anchors(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and the anchor of each node. data: documents end to end, at most CHUNK + length bytes; ends: where each ends."""
    values, up, down = powers()
    b = np.frombuffer(data, np.uint8)
    n, width = len(b), length - gram + 1
    starts = np.concatenate(([0], ends[:-1]))
    long = ends - starts >= length
    if not long.any():
        return (np.zeros(0, np.int64),) * 3
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[b] * up[:n], out=sums[1:])
    v = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    v ^= v >> np.uint64(32)
    v *= np.uint64(0x9E3779B97F4A7C15)
    # The place in the low bits breaks ties: the leftmost of a window.
    v = (v >> np.uint64(24) << np.uint64(24)) | np.arange(len(v), dtype=np.uint64)
    least, k = v, 1
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if k < width:
        least = np.minimum(least[: len(v) - width + 1], least[width - k : width - k + len(v) - width + 1])
    whole = np.zeros(n + 1, np.int32)
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(whole)[: len(least)])
    a = (least[s] & np.uint64(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(s) != 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(s)])) - 1
    return s[first], s[last], a[first]


def stretches(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of about CHUNK bytes: the texts' numbers, where each part begins in its text, and the parts."""
    which, begin, parts, held = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), CHUNK):
            part = t[at : at + CHUNK + length - 1] if len(t) > CHUNK else t
            if held and held + len(part) > CHUNK:
                yield which, begin, parts
                which, begin, parts, held = [], [], [], 0
            which.append(k)
            begin.append(at)
            parts.append(part)
            held += len(part)
            if len(t) <= CHUNK:
                break
    if parts:
        yield which, begin, parts


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def as_bytes(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "replace") for t in texts.to_pylist()]


def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) to (doc_id, digest, at, core, hull). at: first window start, then 8 bits each of the windows less one and of the last one's distance to the anchor."""
    import xxhash

    name = xxhash.xxh64_intdigest
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for which, begin, parts in stretches(as_bytes(part.column(2))):
                data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
                s1, s2, p = anchors(data, ends)
                k = np.searchsorted(ends, s1, side="right")
                core = [name(data[x : x + GRAM]) for x in p.tolist()]
                hull = [name(data[x:y], z) for x, y, z in zip(s1.tolist(), (s2 + LENGTH).tolist(), (p - s2).tolist(), strict=True)]
                starts = np.concatenate(([0], ends[:-1]))
                at = ((s1 - starts[k] + np.array(begin)[k]) << 16) | ((s2 - s1) << 8) | (p - s2)
                row = pa.array(np.array(which)[k])
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(at), signed(core), signed(hull)], names=[*KEY, "at", "core", "hull"])


def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text, nodes) to a row for each node with the bytes of its hull."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            which, nodes, hulls = [], [], []
            for k, (t, own) in enumerate(zip(as_bytes(part.column(2)), part.column(3).to_pylist(), strict=True)):
                for n in own:
                    start = n["at"] >> 16
                    which.append(k)
                    nodes.append(n)
                    hulls.append(t[start : start + (n["at"] >> 8 & 255) + LENGTH])
            row = pa.array(which, pa.int64())
            cols = [pa.array([n[c] for n in nodes], t) for c, t in (("at", pa.int64()), ("open", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), *cols, pa.array(hulls, pa.binary())], names=[*KEY, "at", "open", "bytes"])


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, at, bytes) to (node, block, a0, a1, b0, b1): ranks of the GRAM bytes that the two halves of a block's shared string begin and go on with.

    The block is part of a rank: equal windows lie at equal offsets to their anchors, and one place that two nodes of a text hold isn't met twice.
    """
    import xxhash

    name = xxhash.xxh64_intdigest
    starts = [(k, x, c) for k, (x, c) in enumerate((x, c) for x in (0, SHARED - HALF) for c in (0, GRAM))]
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            which, blocks, names = [], [], ([], [], [], [])
            for k, (at, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                low = at & 255
                high = low + (at >> 8 & 255)
                for block in range(low // BLOCK, high // BLOCK + 1):
                    x = high - BLOCK * block
                    own = text[x : x + SHARED]
                    which.append(k)
                    blocks.append(block)
                    for j, a, c in starts:
                        names[j].append(name(own[a + c : a + c + GRAM], block))
            row = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(blocks, pa.int32()), *map(signed, names)], names=["node", "block", "a0", "a1", "b0", "b1"])


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, at, open, bytes, blocks) to (node, place, open, first, second): the windows of those blocks by their place in the node, with the ranks of their two halves."""
    import xxhash

    name, half = xxhash.xxh64_intdigest, LENGTH - HALF
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            which, places, first, second = [], [], [], []
            for k, (at, text, blocks) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 3, 4)), strict=True)):
                low = at & 255
                high = low + (at >> 8 & 255)
                for block in blocks:
                    for x in range(high - min(high, BLOCK * block + BLOCK - 1), high - max(low, BLOCK * block) + 1):
                        which.append(k)
                        places.append(x)
                        first.append(name(text[x : x + HALF], 1))
                        second.append(name(text[x + half : x + LENGTH], 2))
            row = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(places, pa.int32()), part.column(2).take(row), signed(first), signed(second)], names=["node", "place", "open", "first", "second"])


def cut(text: bytes, ats: list[int] | None) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    if not ats:
        return 0, 0, text
    a = np.sort(np.array(ats, np.int64))
    starts, ends = a >> 16, (a >> 16) + (a >> 8 & 255) + LENGTH
    ends = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    first, last = starts[new], ends[np.concatenate((new[1:], [True]))]
    kept = [text[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True)]
    return int((last - first).sum()), len(first), b"".join(kept)


def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ats) to the result's rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = []
            for t, ats in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                removed, spans, kept = cut(t, ats)
                rows.append((len(t), removed, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def more_than_one(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys of more than one row, as a table: joined from there, and not from the aggregate's own shuffle, a hot key's rows can be split between tasks."""
    return written(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys), "repeated")


def ranked(pairs: DataFrame) -> DataFrame:
    """first, second, rank: the pairs of ranks that occur more than once, in sorted order and numbered by it. Other pairs' positions leave."""
    return written(pairs.groupBy("first", "second").agg(F.count("*").alias("n")).where("n > 1").select("first", "second").orderBy("first", "second").select("first", "second", F.monotonically_increasing_id().alias("rank")), "ranks")


def recurring_blocks(opened: DataFrame) -> DataFrame:
    """node, blocks: those whose shared string occurs elsewhere too, by two rounds of doubling. opened: node, at, bytes."""
    blocks = written(opened.select("node", "at", "bytes").mapInArrow(block_rows, "node long, block int, a0 long, a1 long, b0 long, b1 long"), "blocks")
    pair = lambda df, a, b: df.select(F.col(a).alias("first"), F.col(b).alias("second"))
    named = lambda ranks, a, b, rank: ranks.select(F.col("first").alias(a), F.col("second").alias(b), F.col("rank").alias(rank))
    ranks = ranked(pair(blocks, "a0", "a1").unionByName(pair(blocks, "b0", "b1")))
    doubled = blocks.join(named(ranks, "a0", "a1", "a"), ["a0", "a1"]).select("node", "block", "b0", "b1", "a")
    doubled = written(doubled.join(named(ranks, "b0", "b1", "b"), ["b0", "b1"]).select("node", "block", "a", "b"), "doubled")
    forget(blocks)
    forget(ranks)
    ranks = ranked(pair(doubled, "a", "b"))
    alive = written(doubled.join(named(ranks, "a", "b", "rank"), ["a", "b"]).groupBy("node").agg(F.collect_set("block").alias("blocks")), "alive")
    forget(doubled)
    forget(ranks)
    return alive


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, digest, at): stretches of windows of LENGTH bytes that each occur elsewhere too, and the tables that this reads. docs: doc_id, digest, text."""
    of_id = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest long, at long"
    every = written(docs.mapInArrow(node_rows, f"{of_id}, core long, hull long"), "nodes")
    repeated = more_than_one(every, "core")
    nodes = written(every.join(repeated, "core"), "nodes")
    forget(every)
    forget(repeated)
    first = F.min(F.struct("doc_id", "digest", "at"))
    classes = written(nodes.groupBy("core", "hull").agg(F.count("*").alias("n"), first.alias("first")), "classes")
    done = nodes.join(classes.where("n > 1").select("core", "hull"), ["core", "hull"]).select(*KEY, "at")
    # Cores with several hulls, not all of them repeated, have open nodes.
    disputed = written(classes.groupBy("core").agg(F.count("*").alias("hulls"), F.min("n").alias("least")).where("hulls > 1 AND least = 1").select("core"), "disputed")
    going = classes.join(disputed, "core").select("first.*", F.struct("first.at", (F.col("n") == 1).alias("open")).alias("node"))
    by_doc = going.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.collect_list("node").alias("nodes"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    # Rows equal in both are interchangeable: each gives its nodes, which are copies of each other.
    texts = docs.join(by_doc, same).select(*KEY, "text", "nodes")
    opened = written(texts.mapInArrow(fetched, f"{of_id}, open boolean, bytes binary").withColumn("node", F.monotonically_increasing_id()), "open")
    alive = recurring_blocks(opened)
    asked = opened.join(alive, "node").select("node", "at", "open", "bytes", "blocks")
    windows = written(asked.mapInArrow(window_rows, "node long, place int, open boolean, first long, second long"), "windows")
    forget(alive)
    repeated = more_than_one(windows, "first", "second")
    found = windows.where("open").join(repeated, ["first", "second"]).groupBy("node").agg(F.collect_list("place").alias("places"))
    start = lambda x: (F.shiftright("at", 16) + x) * 65536
    found = found.join(opened.select(*KEY, "at", "node"), "node").select(*KEY, F.explode(F.transform("places", start)).alias("at"))
    return done.unionByName(found), [nodes, classes, disputed, opened, windows, repeated]


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    windows, tables = repeated_windows(docs)
    stretches = windows.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.collect_list("at").alias("ats"))
    stretches = written(stretches, "removed")
    for t in tables:
        forget(t)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return docs.join(stretches, same, "left").select("doc_id", "text", "ats").mapInArrow(verdicts, schema)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
