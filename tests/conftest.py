import pytest

from lexshift.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
