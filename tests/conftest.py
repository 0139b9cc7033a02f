import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """Started in another folder and without PYTHONPATH, so workers can't import the package: its code has to travel."""
    from verdigris.session import local_session

    here = os.getcwd()
    os.environ.pop("PYTHONPATH", None)
    os.chdir(tmp_path_factory.mktemp("elsewhere"))
    s = local_session(4, "tests", 4)
    os.chdir(here)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
