import pytest

from labelforge.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus="4", shuffle=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session
