import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from siltbed.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 4)
