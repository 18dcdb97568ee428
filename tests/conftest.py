import pytest

from trawlframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame('a int, b double', (1, 2.0), ...) as a DataFrame."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
