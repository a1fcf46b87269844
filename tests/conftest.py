from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.session import session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session("tests", "local[4]", 4)
    built.sparkContext.setLogLevel("ERROR")
    built.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("scratch")))
    yield built
    built.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return f"{DATA}/sf0.001"
