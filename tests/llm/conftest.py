from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from brute import ODD  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark):
    """Documents of odd cases, with columns whose names the operators use themselves."""
    frame = spark.createDataFrame(ODD, "doc_id long, text string")
    return frame.withColumns({k: F.lit(7) for k in ("id", "version", "lines", "kept", "fp", "curve", "start", "score", "part")}).repartition(3)


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
