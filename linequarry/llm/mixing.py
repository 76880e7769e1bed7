"""Mixing sources to target weights by temperature.

With p the sources' shares of all tokens, weights are p**alpha, normalised. alpha in [0, 1]
is bisected: the largest alpha whose weights reach the target entropy, raised if need be, by
another bisection, until no source repeats more than max_repeats times. Entropy and repetitions both fall as
alpha grows, so each bisection has one root. The target is entropy_part of the entropy of equal
weights, or entropy_gain of the way there from the shares' own entropy, whichever is more. Where the
repetition limit keeps the weights from it, Fit says so.

A table of up to DRIVER_SOURCES sources (their token counts, 8 bytes each) is bisected on the driver;
beyond that each step is one aggregate over the table.

The weights are then realised: each source gets budget * weight tokens. Its documents lie in
blocks of about BLOCK_TOKENS tokens, by hash; each epoch permutes the blocks, and the
documents in each, by a seeded hash, and a copy is emitted while the tokens before it are
within the source's quota. Prefix sums are taken in three levels, over RANGES ranges of the blocks'
hashes, over a range's blocks, and inside blocks, so that a
source with a third of all rows is spread over as many tasks as it has blocks, and no window holds all its blocks.

budget None takes the least budget at which every source is used whole at least once, so
nothing is dropped and rare sources repeat. A given budget is met, within a token a source, with weights
whose repetitions stay within max_repeats; one of more than max_repeats times all tokens is a
ValueError.

Defined cases: a null text has 0 tokens; a row of 0 tokens rides along with the one before
it in its epoch. A null source is a source of its own. Repeated rows are rows of their own; rows
that share their keys are ordered by their tokens.
A single source has weight 1. An empty table, or one without tokens, gives back its rows
once each (epoch 0). Extra columns, of whatever names, pass through mixed_documents(); mixed() leaves them out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linequarry.llm.common import table, text_or_empty, written

ENTROPY_PART, ENTROPY_GAIN, MAX_REPEATS, BLOCK_TOKENS, SEED = 0.97, 0.5, 2.0, 200_000, 17
DRIVER_SOURCES, HALVINGS, RANGE_BITS = 100_000, 60, 12


def n_tokens(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class At:
    """What weights p**alpha have: their entropy, the normaliser, and the most and least of weight by share."""

    entropy: float
    total: float
    most: float
    least: float


@dataclass(frozen=True)
class Fit:
    """alpha; the shares' own entropy, the target and what the weights reach; met: whether that is the target (else max_repeats keeps it from it)."""

    alpha: float
    own: float
    target: float
    entropy: float
    met: bool


def evaluated(sources: DataFrame, n: int) -> Callable[[float], At]:
    """alpha to At, for the n sources that have tokens. sources: share."""
    some = sources.where("share > 0").select("share")
    if n <= DRIVER_SOURCES:
        p = np.sort(np.array([r.share for r in some.collect()]))

        def at(alpha: float) -> At:
            w = p**alpha
            z = float(w.sum())
            return At(math.log(z) - float((w * np.log(w)).sum()) / z, z, float((w / p).max()) / z, float((w / p).min()) / z)
    else:

        def at(alpha: float) -> At:
            w = some.select("share", F.pow("share", F.lit(alpha)).alias("w"))
            r = w.agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("share")).alias("most"), F.min(F.col("w") / F.col("share")).alias("least")).head()
            return At(math.log(r.z) - r.wl / r.z, r.z, r.most / r.z, r.least / r.z)

    return at


def bisect(good: Callable[[float], bool], low: float = 0.0, high: float = 1.0) -> tuple[float, float]:
    """The bracket of the alpha where good() changes; it changes once, and good(high) isn't good(low)."""
    ends = good(low)
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if good(mid) == ends else (low, mid)
    return low, high


def fitted(at: Callable[[float], At], n: int, entropy_part: float, entropy_gain: float, repeats: Callable[[At], bool]) -> tuple[float, Fit]:
    """The normaliser, and the largest alpha that reaches the target, or the least above it for which repeats() holds."""
    own, most = at(1.0).entropy, math.log(n)
    target = min(most, max(entropy_part * most, own + entropy_gain * (most - own)))
    enough = lambda a: at(a).entropy >= target - 1e-12
    alpha = 1.0 if enough(1.0) else bisect(enough)[0]
    if not repeats(at(alpha)):
        alpha = bisect(lambda a: repeats(at(a)), alpha)[1]
    reached = at(alpha)
    return reached.total, Fit(alpha, own, target, reached.entropy, reached.entropy >= target - 1e-9)


def weighted(docs: DataFrame, entropy_part: float = ENTROPY_PART, max_repeats: float = MAX_REPEATS, budget: int | None = None, entropy_gain: float = ENTROPY_GAIN) -> tuple[DataFrame, Fit]:
    """The sources with tokens, share, weight, quota and n_blocks, and how the weights were found. docs: source, tokens."""
    counts = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    counts = written(counts, "sources")
    total, n = counts.agg(F.sum("tokens"), F.count_if(F.col("tokens") > 0)).head()
    total = total or 0
    if budget is not None and budget > max_repeats * total:
        raise ValueError(f"a budget of {budget} tokens needs more than {max_repeats} repetitions of {total}")
    sources = counts.withColumn("share", F.col("tokens") / F.lit(max(total, 1)))
    z, fit, least = 1.0, Fit(1.0, 0.0, 0.0, 0.0, True), float(total)
    if n > 1:
        at = evaluated(sources, n)
        # Repetitions are budget / total * weight / share; without a budget the source used least is used once.
        limit = (lambda x: x.most <= x.least * max_repeats * (1 + 1e-9)) if budget is None else (lambda x: x.most * budget <= max_repeats * total * (1 + 1e-9))
        z, fit = fitted(at, n, entropy_part, entropy_gain, limit)
        least = total / at(fit.alpha).least
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(fit.alpha)) / z).otherwise(0.0)
    out = sources.withColumn("weight", weight)
    if budget is None:
        quota = F.greatest(F.round(F.lit(least) * F.col("weight")).cast("long"), "tokens")
    else:
        quota = F.round(F.lit(float(budget)) * F.col("weight")).cast("long")
    out = out.withColumn("quota", quota).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long"))
    return out.select("source", "tokens", "share", "weight", "quota", "n_blocks"), fit


def starts(blocks: DataFrame) -> DataFrame:
    """blocks with start: the tokens of the blocks before it in its source's epoch. blocks: source, epoch, block, block_place, block_tokens."""
    blocks = blocks.withColumn("range", F.shiftright("block_place", 64 - RANGE_BITS))
    before = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("source", "epoch", "range").agg(F.sum("block_tokens").alias("n"))
    ranges = ranges.select(F.col("source").alias("__source"), F.col("epoch").alias("__epoch"), F.col("range").alias("__range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("source", "epoch", "range").orderBy("block_place", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("inside", F.coalesce(F.sum("block_tokens").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("epoch") == F.col("__epoch")) & (F.col("range") == F.col("__range"))
    return placed.join(ranges, same).withColumn("start", F.col("__before") + F.col("inside")).drop("__source", "__epoch", "__range", "__before", "inside", "range")


def mixed(docs: DataFrame, keys: list[str], seed: int = SEED, **target) -> DataFrame:
    """A row for each copy that the mix holds: keys, source and tokens of docs, with epoch, block, block_place and place.

    keys: columns that tell rows apart; their hash is what permutes. place orders the documents of a block,
    block_place the blocks of a source and epoch.
    """
    docs = docs.select(*keys, "source", "tokens")
    sources, _ = weighted(docs, **target)
    sources = written(sources, "weights")
    same = F.col("source").eqNullSafe(F.col("__source"))
    per = sources.select(F.col("source").alias("__source"), "quota", "n_blocks", F.col("tokens").alias("of_source"))
    key = F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys])
    rows = docs.join(per, same, "left").withColumn("block", F.pmod(key, F.coalesce("n_blocks", F.lit(1))))
    rows = rows.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest("of_source", F.lit(1))).cast("int")))
    rows = rows.drop("__source", "n_blocks")
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.max("epochs").alias("epochs"), F.max("quota").alias("quota"), F.max("of_source").alias("of_source"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch")).withColumn("block_place", F.xxhash64(F.lit(seed), "epoch", "block"))
    blocks = starts(blocks).withColumn("start", F.col("epoch") * F.col("of_source") + F.col("start"))
    # Blocks that begin past the quota are left out; the one it ends in is cut by the documents' own prefix sums.
    blocks = blocks.where("start < quota OR epoch = 0").select(F.col("source").alias("__source"), F.col("block").alias("__block"), "epoch", "block_place", "start")
    copies = rows.join(blocks, same & (F.col("block") == F.col("__block")))
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed), "epoch", *[F.col(k).cast("string") for k in keys]))
    inside = Window.partitionBy("source", "block", "epoch").orderBy("place", *keys, "tokens")
    at = F.col("start") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    whole = (F.col("epoch") == 0) & (F.col("quota") >= F.col("of_source"))
    return copies.withColumn("at", at).where(whole | (F.col("at") < F.col("quota"))).select(*docs.columns, "block", "epoch", "block_place", "place", "at")


def mixed_documents(docs: DataFrame, **target) -> DataFrame:
    """docs as the mix has them, each row as often as it occurs there, with its own columns alone. doc_id and text: at least."""
    names = docs.columns
    ids = written(docs.select("doc_id", "source", n_tokens().alias("tokens"), F.xxhash64(text_or_empty()).alias("digest")), "tokens")
    ids = ids.groupBy("doc_id", "source", "digest").agg(F.max("tokens").alias("tokens"), F.count("*").alias("copies"))
    # Rows equal in id, source and text move together; tokens counts them all.
    ids = ids.withColumn("tokens", F.col("tokens") * F.col("copies")).drop("copies")
    copies = mixed(ids, ["doc_id", "digest"], **target).groupBy("doc_id", "source", "digest").agg(F.count("*").alias("times"))
    # A row is one column here, so that no name of its own can meet ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.xxhash64(text_or_empty()).alias("of_text"))
    same = F.col("of_id").eqNullSafe(F.col("doc_id")) & F.col("of_source").eqNullSafe(F.col("source")) & (F.col("of_text") == F.col("digest"))
    # Where nothing is dropped, only rows that repeat need to be joined.
    out = rows.join(copies.where("times <> 1"), same, "left") if target.get("budget") is None else rows.join(copies, same)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))).alias("nth")).select(*[F.col("row")[c].alias(c) for c in names])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = written(docs.select("doc_id", "source", n_tokens().alias("tokens")), "tokens")
    return mixed(ids, ["doc_id"]).select("doc_id", "source", "tokens", "epoch", "block", "block_place", "place")
