import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
#: Columns whose names an operator might use on its way.
CLASHES = {"id": 1, "size": 2, "node": 3, "key": "k", "__text": "t", "__row": "r", "__t": 4, "spans": 5, "n": 6, "score": 7}


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 997} and token{i}" for i in range(20_000))
    same = "one two three four five six seven eight nine ten " * 6
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (4, same, None, None, None), (4, same, None, None, None),
        (5, same + "x", "de", "b", 9), (None, same, "de", "b", 9), (None, None, None, None, None), (6, " \n\t ", "fr", "b", 4), (7, "é" * 300, "fr", "b", 300),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, node long, key string, __text string, __row string, __t long, spans long, n long, score long"
    return spark.createDataFrame([(*r, 1, 2, 3, "k", "t", "r", 4, 5, 6, 7) for r in rows], schema)


@pytest.fixture
def none(odd):
    return odd.limit(0)
