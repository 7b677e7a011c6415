import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweir.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    yield s
    s.stop()


@pytest.fixture
def make_events(spark):
    """Events of (line_id, block_id, template_id[, level]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2], r[3] if len(r) > 3 else "INFO") for r in rows]
        return spark.createDataFrame(full, "line_id long, block_id string, template_id long, level string")

    return make
