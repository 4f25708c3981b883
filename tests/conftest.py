import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codelake.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    yield s


def files_df(spark, rows):
    """(repo, path, content) literal rows -> src_files."""
    from codelake.sources.corpus import ingest
    return ingest(spark.createDataFrame(rows, "repo string, path string, content string"))
