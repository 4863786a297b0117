"""Shared local session for the test-suite (local mode, small shuffle width, private checkpoint folder)."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cohortflow.session import build_session

    s = build_session(cores=4, shuffle_partitions=4, app="cohortflow-tests")
    yield s
    s.stop()
