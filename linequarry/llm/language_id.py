"""Language ID by compression.

For each language a zstandard raw-content dictionary is filled with text of that language.
A document's letters are cut into pieces of PIECE bytes and every piece is compressed with
each dictionary; the language whose dictionary gives the fewest bytes in all wins, and a
document is rejected when the runner-up is within MARGIN. Pieces are compressed on their
own, so that a long text can't become its own dictionary and wash out the difference.

Fitting reads a bounded, labelled sample: up to SAMPLE_DOCS documents a language, chosen by
a hash of the id, up to OF_EACH bytes of letters from each, fill SAMPLE_BYTES of dictionary. Prediction reads whole texts, and nothing but the text.

Defined cases: a null text, and one without any letter, is `und` with score 0 and is
rejected. Ties go to the language first in code point order. With no labelled row there is
no language, and all is `und`. Null languages and null ids are never learned from. Extra
columns pass through identified() unless they bear the names it adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linequarry.functions.shipping import ship
from linequarry.llm.common import table

#: LEVEL 6 is the first whose search is thorough enough for dictionaries of syllables; above 12 zstd drops them for short input.
SAMPLE_DOCS, SAMPLE_BYTES, OF_EACH, PIECE, LEVEL, MARGIN = 80, 48 << 10, 2000, 2 << 10, 6, 0.005
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased, all that isn't letters turned into single spaces."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def is_held_out(fold: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == fold, F.lit(False))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """The dictionaries. labelled: doc_id, text, lang; at most sample_docs documents for each language reach the driver."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = sizes.count()
    if not n_langs:
        return {}
    # A language's i-th smallest hash lies near i/n: ordering by hash times n takes evenly from all.
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) * F.col("n")
    picked = rows.join(F.broadcast(sizes) if n_langs < 10_000 else sizes, "lang").select("doc_id", "lang", place.alias("place")).orderBy("place", "doc_id").limit(sample_docs * n_langs).collect()
    texts: dict[tuple, str] = {}
    for r in rows.where(F.col("doc_id").isin([r.doc_id for r in picked])).select("doc_id", "lang", F.substring("text", 1, 4 * OF_EACH).alias("text")).collect():
        texts[r.lang, r.doc_id] = max(r.text, texts.get((r.lang, r.doc_id), ""))
    content: dict[str, list[bytes]] = {}
    for r in picked:
        content.setdefault(r.lang, []).append(letters(texts[r.lang, r.doc_id])[:OF_EACH])
    # zstd finds what is near the end of a dictionary cheapest; the order has no other meaning.
    return {lang: b" ".join(content[lang])[:sample_bytes] for lang in sorted(content)}


@lru_cache(maxsize=4)
def compressors(model: tuple[tuple[str, bytes], ...], level: int) -> list:
    import zstandard as z

    out = []
    for _, content in model:
        d = z.ZstdCompressionDict(content or b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(z.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def judge(text: str | None, model: tuple[tuple[str, bytes], ...], margin: float = MARGIN) -> tuple[str, float, bool]:
    """Language, score (how much smaller the best is than the runner-up, 0 to 1) and whether it is rejected."""
    if not text or not model or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    data = b" " + letters(text) + b" "
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for c, (lang, _) in zip(compressors(model, LEVEL), model, strict=True))
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    score = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], score, score < margin


def identified(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    ship(docs.sparkSession)
    fixed = tuple(sorted(model.items()))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(t, fixed, margin) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.drop("lang_pred", "score", "rejected").withColumn("__v", verdict("text")).select("*", "__v.*").drop("__v")


def keep_identified(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    ship(docs.sparkSession)
    fixed = tuple(sorted(model.items()))

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not judge(t, fixed)[2] for t in texts], dtype=bool)

    return docs.where(accepted("text"))


def fit_on_folds(docs: DataFrame) -> dict[str, bytes]:
    return fit(docs.where(~is_held_out()).select("doc_id", "text", "lang"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs.select("doc_id", "text"), fit_on_folds(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
