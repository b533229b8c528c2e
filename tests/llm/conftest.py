import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, repeated and long texts, and columns with clashing names."""
    long = "word " * 20000 + "x" * 50000 + " 1 2 3 4" * 4000 + " a.b.c" * 3000
    rows = [(1, None), (None, "no id idiot"), (2, ""), (3, " \n\t "), (4, "same words here for all to see"),
            (4, "same words here for all to see"), (5, "same words here for all to see"), (6, long), (7, "\u0001 x@y.zz \u0001"),
            (8, "naïve 😀 text <|im_end|> <|endoftext|> end  two  spaces\r\n"), (9, "one")]
    return spark.createDataFrame([(i, t, "en", "s", 1, "rest", 1) for i, t in rows],
                                 DOCS + ", rest string, sequence_id long")
