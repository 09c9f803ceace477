import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spanveil.session import build_session, checkpoint_root  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false",
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def checkpoint(spark):
    return f"{checkpoint_root(spark)}/spanveil-tests-{uuid.uuid4().hex}"
