import pytest

from aligngrid.session import make_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = make_session(8, shared=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
