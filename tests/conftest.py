import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import build_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"
