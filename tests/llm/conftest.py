import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from llm_cases import ODD_TEXTS, SF  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    from cohort.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of the smallest table, in order."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD_TEXTS with an extra column whose name clashes with results, null keys among the rows."""
    rows = [(None if i in (3, 9) else i, t, "lang", i) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
