import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(autouse=True)
def shipped(spark):
    from kinloom.runtime import ship

    return ship(spark)
