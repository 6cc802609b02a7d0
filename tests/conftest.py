import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from lodestone.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""

    def value(expression, **columns):
        names = list(columns) or ["x"]
        values = tuple(columns.values()) or (0,)
        schema = ", ".join(
            f"{n} " + ("array<string>" if isinstance(v, list) else "bigint" if isinstance(v, int) else "string")
            for n, v in zip(names, values)
        )
        return spark.createDataFrame([values], schema).select(expression.alias("v")).head()[0]

    return value
