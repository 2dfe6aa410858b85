import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from rookery.session import session

    return session("local[8]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
