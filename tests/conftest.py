import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corroborate.session import local_session  # noqa: E402

# Column expressions in test modules need a running session.
SHARED = tempfile.mkdtemp(prefix="spark-")
SESSION = local_session("8", partitions=4, memory="6g", shared=SHARED)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression over one row of named values."""
    from pyspark.sql import functions as F

    def run(expression, **columns):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()] or ["id"])
        return row.select(expression.alias("x")).first()["x"]

    return run
