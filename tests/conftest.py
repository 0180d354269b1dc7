import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    s = session("local[8]", partitions=8, spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")), spark_driver_memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
