from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tagmill.session import session

    spark = session(4, 4)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
