import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from blobs import blob_arrays  # noqa: E402

from vectorloom.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        # Small test data must still be spread over several partitions.
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return TESTDATA


@pytest.fixture(scope="session")
def blobs(spark):
    points, labels = blob_arrays()
    rows = [(i, p.tolist(), int(y)) for i, (p, y) in enumerate(zip(points, labels))]
    frame = spark.createDataFrame(rows, "id long, features array<double>, label int")
    return frame.repartition(3).cache()
