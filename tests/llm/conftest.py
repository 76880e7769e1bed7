import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("needs the tables")
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table, with columns whose names the operators use themselves."""

    def build(rows):
        rows = [(*r, *(None, None)[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        full = [(i, t, lang, s, len(t) if t is not None else None, "x", 7, True) for i, t, lang, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, row int, kept boolean")

    return build


@pytest.fixture(scope="session")
def plain():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
