import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohort.session import get_spark, checkpoint_dir
    s = get_spark("local[4]", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
