import random

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60_000))
    rows = [(1, "", "en", "a"), (2, None, "en", "a"), (None, "some words without any id", None, None), (3, " \t\n ", None, "b"), (4, long, "de", "b"), (5, "repeated row", "de", "b"), (5, "repeated row", "de", "b"), (6, "12345 !!", "fr", None)]
    clash = "lang_pred string, score double, rejected boolean, n_words long, spans string, items long, fp long, _gone long, h long, s int, _ld_key long, row long"
    rows = [(*r, len(r[1] or ""), "x", 0.5, True, 3, "s", 7, 8, 9, 10, 11, 12, 13) for r in rows]
    return spark.createDataFrame(rows, f"{DOC}, {clash}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
