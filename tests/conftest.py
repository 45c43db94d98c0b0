import pytest

from papertally.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(shuffle_partitions=4)
