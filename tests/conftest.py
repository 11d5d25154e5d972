import pytest

from millrace.session import session


@pytest.fixture(scope="session")
def spark():
    return session("4", 4, "4g")
