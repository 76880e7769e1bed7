"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary (Spark's mergeable frequent-items sketch) of the text digests names
at most CANDIDATES digests that may be frequent. Those are counted exactly, with partial
aggregation, and the ones held by at least one row in HEAVY_ONE_IN are the verified heavy
hitters: their winners, at most HEAVY_ONE_IN rows, are broadcast and settle their copies
map-side, unshuffled. All other digests are shuffled: an aggregate, combined map-side, gives
the winners of those that several rows share, and a join with their table settles those rows, so that
no group, whatever its size, has to meet in one task. A frequent digest that the summary misses is
still settled there; the summary only decides the way, never the result.

Defined cases: a null text counts as empty, and all empty or white-space-only texts are
copies of each other. Ties in length go to the smallest doc_id, null ids last; of rows that
agree in both, exactly one stays. An empty table gives no rows. Other columns are ignored
by exact_dedup() and passed through by drop_exact_copies().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linequarry.llm.common import SPACE, table, text_or_empty, written

#: Items that the summary tracks, and candidates taken from it: with 16384 tracked, a digest with one row in 1024 is certain to be among them.
TRACKED, CANDIDATES, HEAVY_ONE_IN = 16384, 2048, 1024


def digest():
    """SHA-256 of the text without white space, as lowercase hex."""
    return F.sha2(F.regexp_replace(text_or_empty(), SPACE + "+", ""), 256)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    rows = written(
        docs.select("doc_id", F.char_length(text_or_empty()).cast("long").alias("size"), digest().alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    summary = rows.agg(F.expr(f"approx_top_k(text_sha256, {CANDIDATES}, {TRACKED})").alias("items"), F.count("*").alias("total"))
    candidates = summary.select("total", F.explode("items.item").alias("text_sha256"))
    best = F.min(F.struct((-F.col("size")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    settled = ["text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")]
    frequent = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max("total").alias("total"), best)
    winners = written(frequent.where(F.col("group_size") * HEAVY_ONE_IN >= F.col("total")).select(*settled), "winners")
    heavy = rows.join(F.broadcast(winners), "text_sha256").withColumn("kept", F.col("row") == F.col("keep_row"))
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # From a table, so that the rows of one digest can be split between the join's tasks.
    groups = written(light.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best).where("group_size > 1").select(*settled), "groups")
    alone = F.col("keep_row").isNull()
    light = light.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return heavy.select(*out).unionByName(light.select(*out))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns."""
    names, dropped = docs.columns, exact_dedup(docs).where(~F.col("kept"))
    other = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    ids = lambda df: df.select("doc_id", "text_sha256").distinct()
    # A row is one column here, so that no name of its own can meet ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("of_id"), digest().alias("of_text"), F.char_length(text_or_empty()).alias("size"))
    same = F.col("of_id").eqNullSafe(F.col("doc_id")) & (F.col("of_text") == F.col("text_sha256"))
    own = [F.col("row")[c].alias(c) for c in names]
    # A row that shares even its id with the row that stays can't be told from it by (id, digest).
    repeated = written(ids(dropped.where(other)), "repeated")
    rest = rows.join(ids(dropped.where(~other)), same, "left_anti")
    once = rest.join(repeated, same, "left_anti").select(*own)
    if not repeated.head(1):
        return once
    twice = rest.join(repeated, same, "left_semi").groupBy("of_id", "of_text").agg(F.max_by("row", "size").alias("row"))
    return once.unionByName(twice.select(*own))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
"""
