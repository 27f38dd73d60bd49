import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from codegrain.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session("tests", 4, spark__checkpoint__dir=f"file://{folder}", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__warehouse__dir=str(folder / "warehouse"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
