import pytest

from lorewright.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('stored')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
