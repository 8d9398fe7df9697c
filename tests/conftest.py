import pytest

from lexmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
                                     "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
