import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The awkward corpus as files, so that every read gives the same rows in the same order."""
    import fixtures

    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    fixtures.make(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)
