import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from talkgrid.session import build_session

    return build_session(cores=4, **{"spark.sql.shuffle.partitions": "4"})
