import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from nearwise import get_spark  # noqa: E402
from nearwise.session import clear_working_tables, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Start away from the repository: workers must not depend on finding the package in their folder.
    os.chdir(tmp_path_factory.mktemp("elsewhere"))
    session = get_spark(
        "nearwise-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_working_tables(session)
    left = [name for _, _, names in os.walk(shared_dir(session)) for name in names]
    session.stop()
    assert not left
