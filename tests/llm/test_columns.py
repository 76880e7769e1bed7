"""Tables with extra columns that bear the names which the operators use themselves, next to empty tables."""

import pytest
from pyspark.sql import functions as F

from linequarry.llm import exact_dedup, html_extraction, language_id, license_scan, mixing, quality_rules, sentencepiece_unigram, simhash_dedup, substring_dedup

NAMES = (
    "n row kept size best items total code root node bucket edges won component_id fingerprint digest at core hull blocks places first second rank found words paragraphs yes license families confidence "
    "hashes pairs lines distance base_failed judge pools bin d2 x0 m0 l00 level start tokens block epoch place quota times nth ids n_tokens round_trip lang_pred score rejected held_out text_sha256 keep_id "
    "group_size __id __digest __n __code __source __v __nth __again_id __gone_id n_chars"
).split()
WORDS = "the quick brown fox jumps over the lazy dog and runs away from all of them in the dark of the night".split()


def make(spark, rows):
    texts = [" ".join(WORDS[(i * k) % len(WORDS)] + str(i % 3) for k in range(60)) for i in range(6)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*texts, texts[0], None, ""])][:rows] if rows else [], "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("own").alias(n) for n in NAMES])


OPERATORS = {
    "op1": lambda d: license_scan.scanned(d, license_scan.train([])),
    "op2": mixing.mixed_documents,
    "op3": lambda d: quality_rules.quality(d, pooled=True),
    "op5": lambda d: language_id.keep_identified(d, {"en": b"the quick brown fox", "fr": b"le chat noir"}),
    "op5 columns": lambda d: language_id.identified(d, {"en": b"the quick brown fox", "fr": b"le chat noir"}),
    "op6": simhash_dedup.near_duplicates,
    "op6 rows": simhash_dedup.drop_near_copies,
    "op8": substring_dedup.substring_dedup,
    "op9": sentencepiece_unigram.encoded,
    "op10": exact_dedup.exact_dedup,
    "op10 rows": exact_dedup.drop_exact_copies,
    "op4": lambda d: html_extraction.extracted(d.withColumnRenamed("lang", "html")),
}
PASSING = {"op2", "op5", "op6 rows", "op10 rows"}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_extra_column(spark, name):
    df = make(spark, 9)
    out = OPERATORS[name](df)
    rows = out.collect()
    assert rows
    if name in PASSING:
        assert out.columns == df.columns and all(r[n] == "own" for r in rows for n in NAMES)
    else:
        assert len(out.columns) == len(set(out.columns))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](make(spark, 0)).count() == 0
