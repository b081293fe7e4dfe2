import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix boxes of jugs and a calm river bends past old stone mills near hills"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, a column with a clashing name."""
    long_text = " ".join(f"{PROSE} {i}" for i in range(3000))
    near = PROSE.replace("calm", "quiet")
    rows = [(1, PROSE, "en", 1), (2, None, None, None), (3, "", "en", 0), (4, " \n\t ", "en", 4), (5, long_text, "en", len(long_text)), (6, PROSE, "de", 1), (6, PROSE, "de", 1), (None, PROSE, "en", 1), (7, near, "en", 9), (8, "one", None, 3), (9, "x" * 5000, "en", 5000)]
    return spark.createDataFrame([(*r, 0.5, "s") for r in rows], "doc_id long, text string, lang string, n_chars long, score double, node string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    """The smallest data folder."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
