"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are made per document in Arrow batches; only (doc_id, fingerprint) goes on.
Equal fingerprints are joined first, so all that follows works on distinct ones.

The top of the hierarchy is distributed. Of n blocks of bits, two fingerprints that differ in
at most 4 bits agree on n - 4 at least, so each fingerprint goes to one top node for each
choice of n - 4 blocks, whose mask is those blocks and whose pattern their bits. n is 5 to 8, by the
number of fingerprints, so that top nodes have some hundred members each: 5 nodes for each
fingerprint up to 2 million of them, 15 up to 537 million, 35 up to 68 thousand million, then 70. A top
node with more than FULL members, as skewed fingerprints make them, is split further: the bits that all
of its members share are factored into its mask (by an aggregate), the other bits are cut in 5 blocks
and its members go to a child for each, of which again one holds both of any two that are
near. Children share ever more bits, and FULL distinct fingerprints can't share all but 11, so
this ends; no two tiles of a node ever need to be compared, and nothing is dropped.

Index: a top node's fingerprints, FULL at most, are sorted by Gray rank, so that neighbours share long runs
of bits. Runs of FAN form nodes, runs of FAN nodes the nodes above. A node holds the bits
that all below it share (mask) and their values (pattern); bits that its parent has are
factored out, so a node adds only what its parent left open. A search goes down the
hierarchy with pairs of nodes at once, adding up the differences on newly shared bits, and
prunes both groups whole once the sum passes the threshold.

The links of a bucket are reduced to a spanning forest (each linked fingerprint with the
smallest one that it reaches inside the bucket), which keeps all components and never
holds a group's pairs. Components come from min-label propagation with pointer jumping over
these edges, each round a table in the shared folder.

Defined cases: a null text and one without words have fingerprint zero, linked like any
other. With 1 to 3 words the whole sequence is the one shingle. Repeated rows have equal
fingerprints and one component. Null ids don't count as smallest; a component of null ids
alone has a null component_id. drop_near_copies() keeps one row of each component, that of least
id and fingerprint: rows that share an id, null too, are told apart by their fingerprints. An empty table gives no rows. Extra columns are ignored by
near_duplicates() and passed through by drop_near_copies().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linequarry.functions.shipping import ship
from linequarry.llm.common import forget, table, written, written_alone

WORDS, SEED, DISTANCE, FAN, TOP, FULL = 4, 42, 4, 2, 64, 2048
#: Top nodes are chosen to have so many members at most where fingerprints are evenly spread.
EXPECTED = 512
ONE = np.uint64(1)


# --- fingerprints


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text: bits set in over half of its shingles' hashes."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As signed longs, Spark's only 64-bit type."""
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


# --- the index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Levels of (pattern, mask), the leaves first, over codes in Gray order."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.codes, self.fan = codes[np.argsort(gray_rank(codes), kind="stable")], fan
        self.met = 0  # pairs of codes that links() compared; all others were pruned above
        every, some = self.codes, self.codes
        self.levels = [(self.codes, np.full(len(codes), ~np.uint64(0)))]
        while len(every) > max(fan, TOP):  # so few are compared each with each
            at = np.arange(0, len(every), fan)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            self.levels.append((every, ~(every ^ some)))

    def links(self, distance: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all pairs of codes within the distance, each once, in portions."""
        height = len(self.levels) - 1
        p, m = self.levels[height]
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(p)), np.arange(len(p)), indexing="ij"))
        a, b = a[a <= b], b[a <= b]
        both = m[a] & m[b]
        stack = [(height, a, b, np.bitwise_count((p[a] ^ p[b]) & both).astype(np.int64), both)]
        while stack:
            level, a, b, found, seen = stack.pop()
            self.met += len(a) if not level else 0
            keep = found <= distance
            a, b, found, seen = a[keep], b[keep], found[keep], seen[keep]
            if not level:
                a, b = a[a < b], b[a < b]
                if len(a):
                    yield a, b
                continue
            p, m = self.levels[level - 1]
            step = max(1, most // (self.fan * self.fan))
            offs = np.arange(self.fan)
            for i in range(0, len(a), step):
                x = (a[i : i + step, None] * self.fan + offs)[:, :, None]
                y = (b[i : i + step, None] * self.fan + offs)[:, None, :]
                x, y = np.broadcast_arrays(x, y)
                at = np.repeat(np.arange(i, min(i + step, len(a))), self.fan * self.fan)
                x, y = x.ravel(), y.ravel()
                real = (x < len(p)) & (y < len(p)) & (x <= y)
                x, y, at = x[real], y[real], at[real]
                both = m[x] & m[y]
                stack.append((level - 1, x, y, found[at] + np.bitwise_count((p[x] ^ p[y]) & both & ~seen[at]), both))


def forest(codes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(code, smallest code that it reaches) for each linked code."""
    values = np.unique(codes)
    up = np.arange(len(values))
    index = GrayIndex(values)
    for x, y in index.links(distance):
        a, b = np.searchsorted(values, index.codes[x]), np.searchsorted(values, index.codes[y])
        while len(a):  # each pass hangs the larger root under the smaller
            while not np.array_equal(up, up[up]):
                up = up[up]
            ra, rb = up[a], up[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
    while not np.array_equal(up, up[up]):
        up = up[up]
    linked = up != np.arange(len(values))
    return values[linked], values[up[linked]]


# --- distributed search


def blocks(n: int) -> list[int]:
    """Masks of n blocks of 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def top_masks(n_codes: int, distance: int = DISTANCE, expected: int = EXPECTED) -> list[int]:
    """The masks of the top nodes, for so many codes: all choices of n - distance of n blocks, of the least n that gives expected members a node."""
    for n in range(distance + 1, 2 * distance + 1):
        masks = [sum(some) for some in combinations(blocks(n), n - distance)]
        if n_codes <= expected << min(m.bit_count() for m in masks):
            break
    return masks


def as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def node_edges(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, code) sorted by node, some FULL codes a node, to the edges of each node's forest."""
    held: list[pd.DataFrame] = []

    def edges(codes: np.ndarray) -> pd.DataFrame:
        a, b = forest(codes.view(np.uint64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def split(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        keys = pdf["node"].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        return [pdf.iloc[i:j] for i, j in zip([0, *cuts], [*cuts, len(pdf)], strict=True)]

    for pdf in rows:
        if not len(pdf):
            continue
        groups = split(pd.concat([*held, pdf], ignore_index=True))
        held = [groups.pop()]
        if done := [edges(g["code"].to_numpy()) for g in groups if len(g) > 1]:
            yield pd.concat(done)
    for g in held:
        if len(g) > 1:
            yield edges(g["code"].to_numpy())


def child_masks(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, every, some) to (node, masks): the bits that a node's members don't share, more than DISTANCE, in DISTANCE + 1 blocks of about equal size."""
    for pdf in rows:
        masks = []
        for varied in (pdf["every"] ^ pdf["some"]).to_numpy().view(np.uint64).tolist():
            bits = [i for i in range(64) if varied >> i & 1]
            edges = [len(bits) * i // (DISTANCE + 1) for i in range(DISTANCE + 2)]
            masks.append([as_long(sum(1 << i for i in bits[a:b])) for a, b in zip(edges, edges[1:], strict=False)])
        yield pd.DataFrame({"node": pdf["node"], "masks": masks})


def split_full(routed: DataFrame, full: int) -> DataFrame:
    """(node, code): the rows of nodes of at most so many members, and those of larger ones routed to children, down to as small ones. routed: a written table."""
    done = None
    while True:
        sizes = routed.groupBy("node").agg(F.count("*").alias("n"), F.bit_and("code").alias("every"), F.bit_or("code").alias("some"))
        hot = written(sizes.where(F.col("n") > full).select("node", "every", "some"), "full")
        n = hot.count()
        if not n:
            return routed if done is None else done.unionByName(routed)
        # Broadcast up to 50,000 rows of 16 bytes; beyond that Spark's own choice.
        hint = F.broadcast if n <= 50_000 else lambda x: x
        small = routed.join(hint(hot.select("node")), "node", "left_anti")
        done = small if done is None else done.unionByName(small)
        masks = written(hot.mapInPandas(child_masks, "node long, masks array<long>"), "masks")
        below = routed.join(hint(masks), "node").select("node", "code", F.posexplode("masks").alias("i", "mask"))
        # Nodes are told apart by a hash: if two were one, more would be compared, and nothing lost.
        routed = written(below.select(F.xxhash64("node", "i", F.col("code").bitwiseAND(F.col("mask"))).alias("node"), "code"), "routed")


def link_edges(codes: DataFrame, distance: int = DISTANCE, full: int = FULL, expected: int = EXPECTED) -> DataFrame:
    """(a, b) with b < a unsigned: edges that connect all distinct codes within the distance. codes: distinct, column code."""
    if full < 1 << distance:
        raise ValueError("fingerprints that share all but a few bits must fit a node")
    ship(codes.sparkSession)
    masks = [as_long(m) for m in top_masks(codes.count(), distance, expected)]
    node = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("node")
    routed = split_full(written(codes.select(node, "code"), "routed"), full)
    dealt = routed.repartition("node").sortWithinPartitions("node")
    return dealt.mapInPandas(node_edges, "a long, b long").distinct()


def components(edges: DataFrame, at_most: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest of its component as a signed number."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    for _ in range(at_most):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("of"), F.col("root").alias("beyond"))
        fresh = written(low.join(jump, F.col("root") == F.col("of"), "left").select("node", "old", F.least("root", "beyond").alias("root")), "labels")
        moved = fresh.where("root <> old").limit(1).count()
        forget(labels)
        labels = fresh
        if not moved:
            return labels.select("node", "root")
    raise RuntimeError(f"components did not settle in {at_most} rounds")


def judged(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, code, root (of the component), component_id: one row per row of docs."""
    ship(docs.sparkSession)
    prints = written(docs.select("doc_id", fingerprints("text").alias("code")), "prints")
    codes = prints.groupBy("code").agg(F.min("doc_id").alias("least_id"))
    codes = written(codes, "codes")
    # The routed fingerprints, the edges and the rounds' labels go once their outcome is a table.
    found = written_alone(lambda: components(link_edges(codes.select("code"), distance)), "linked")
    rooted = codes.join(found, F.col("code") == F.col("node"), "left").select("code", "least_id", F.coalesce("root", "code").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = rooted.join(least, "root").select("code", "root", "component_id")
    return prints.join(ids, "code").select("doc_id", "code", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs."""
    return judged(docs, distance).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, of the smallest id and then fingerprint; where rows are equal in both, one of them."""
    names = docs.columns
    found = written(judged(docs), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    winners = written(found.where(stays).groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("code").alias("code")), "winners")
    # Most ids have one row, which the id alone tells apart; the others need fingerprints again.
    both = found.select("doc_id", F.lit(1).alias("n"), F.lit(0).alias("won")).unionByName(winners.select("doc_id", F.lit(0).alias("n"), F.lit(1).alias("won")))
    fates = both.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("won").alias("won"))
    fates = written(fates.where("won = 0 OR n > 1 OR doc_id IS NULL"), "fates")
    ided = docs.where("doc_id IS NOT NULL")
    rest = ided.join(fates.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_anti").select(*names)
    again = fates.where("won > 0")
    if not again.head(1):
        return rest
    several = ided.join(again.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_semi").select(*names).unionByName(docs.where("doc_id IS NULL"))
    # Aggregated before the join: rows equal in both keys are reduced where they are, and never meet in one task.
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    one = several.groupBy(F.col("doc_id").alias("__id"), fingerprints("text").alias("__code")).agg(F.max_by(row, F.struct(F.col("text").isNotNull(), F.col("text"))).alias("row"))
    kept = one.join(winners, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__code") == F.col("code")), "left_semi")
    return rest.unionByName(kept.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(names)]))


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
