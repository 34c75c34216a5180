import pytest

from lodestrata.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=8, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
