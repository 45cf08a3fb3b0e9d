"""One small local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shardloom.session import create_session

    folder = tmp_path_factory.mktemp("spark")
    s = create_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__host="127.0.0.1",
        spark__driver__memory="3g", spark__checkpoint__dir=f"file://{folder}/shared", spark__sql__warehouse__dir=f"{folder}/warehouse",
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
