import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import random  # noqa: E402

import pytest  # noqa: E402


@pytest.fixture
def rng():
    return random.Random(4)
