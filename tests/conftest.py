import pytest

from corvane.plans.runtime import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
