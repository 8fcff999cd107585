import pytest

from lantern.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="8", shuffle="8", memory="6g")
