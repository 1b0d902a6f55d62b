import os
import sys
from pathlib import Path

# before numpy is loaded: its thread pool can hang beside the gateway's threads
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from riverspark.session import build_session

    yield build_session(4, **{"spark.sql.shuffle.partitions": "4"})
