import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))]})
EN = "the and of with that this from other words are here for reading by many people in the house "
DE = "der und die das nicht mit auf ist ein eine von dem den werden haben sein über größer "


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, very long, repeated and clashing rows."""
    rows = [
        (1, EN * 3, "en", "a", 10), (2, EN * 3, "en", "a", 10), (2, EN * 3, "en", "a", 10), (3, DE * 3, "de", "b", 10), (4, None, "en", "a", None), (5, "", None, None, 0),
        (6, " \n\t ", "en", "a", 3), (None, "no id here " * 9, "en", "c", 5), (7, EN * 20_000, "en", "a", 9), (8, "x" * 300_000, None, "a", 9), (9, "12 34 !! ?", "de", "b", 1),
        (10, DE * 4 + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" und', "de", "b", 1), (11, "über ünïcode ▁ 日本語 😀 \u0000 ende", "de", "b", 1), (12, EN * 3 + "!", "en", "a", 10),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns named as what operators add."""
    from pyspark.sql import functions as F

    names = ["score", "Kept", "lang_pred", "start", "ids", "n_tokens", "copy", "shuffle_key", "component_id", "row", "key", "__text", "predicted"]
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
