import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
    from sitemill.session import local_session

    s = local_session(4, app="sitemill-llm-tests")
    s.sparkContext.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
    yield s


#: Texts with the awkward cases: null, empty, blank, very long, ties, repeats.
LONG = "alpha beta  gamma\tdelta " * 9000
TEXTS = [None, "", " \n\t ", LONG, "one", "two words", "a b c d e f g", "a b c  d e f g", "A b c d e f g", "héllo wörld 漢字 " * 40, "x" * 30000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Awkward texts, each row twice, a null doc_id, and further columns whose names the operators use inside."""
    rows = [(k, t, None, "s", None, "x", 1, None) for k, t in enumerate(TEXTS)] * 2 + [(None, "null id", "en", None, 3, None, None, None), (2**60 + 1, "large id", "en", None, 3, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, rank double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
