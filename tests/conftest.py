import pytest

from cohortscale.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=8, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
