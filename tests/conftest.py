import pytest

from barloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "barloom-tests", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
