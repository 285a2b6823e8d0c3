import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textscore.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(master="local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        # Small test tables must still be cut into several slices.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def rows():
    def collect(df, *order):
        return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return collect
