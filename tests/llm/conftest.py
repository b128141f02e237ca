import pytest

ODD = [None, "", " ", "\n\n \t", "one", "a b", "ÀÉ ñ 日本語 ▁x", "word " * 4000, "x" * 30000, "tie tie tie", "tie tie tie"]


@pytest.fixture
def odd_docs(spark):
    """Null, empty, blank, very long and repeated texts, null ids and sources, and columns with names in use."""
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else f"s{i % 2}", i, "k") for i, t in enumerate(ODD)]
    rows += rows[-2:]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, key string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, size int, key string")
