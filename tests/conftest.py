from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cliplab.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture
def clip_rows(spark):
    """Three clips of two frames; the last clip is a tie in label and vote."""
    rows = [
        ("c1", 0, 0.1, 0, 0), ("c1", 1, 0.4, 0, 0), ("c2", 0, 0.8, 1, 1), ("c2", 1, 0.9, 1, 1),
        ("c3", 0, 0.2, 0, 0), ("c3", 1, 0.7, 1, 1),
    ]
    return spark.createDataFrame(rows, "clip_key string, frame int, prob double, pred int, label int")
