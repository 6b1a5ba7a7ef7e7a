from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from recordlake.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", master="local[4]", shuffle_partitions=4)
