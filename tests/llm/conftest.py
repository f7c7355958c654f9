import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import DOCS, awkward, with_clashes


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return with_clashes(spark.createDataFrame(rows, DOCS).repartition(3)).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
