import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from ledgerfold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="8g", spark_ui_enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
