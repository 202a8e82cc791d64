import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from epiquery.session import get_session

    s = get_session(4, 4, "4g")
    yield s
    s.stop()


@pytest.fixture
def scratch(spark, request):
    from epiquery.storage import Scratch

    return Scratch(spark, request.node.name[:40].replace("[", "-").replace("]", "-"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
