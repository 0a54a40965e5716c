import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rolefit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=8, shuffle_partitions=2)


@pytest.fixture
def one(spark):
    """Evaluate one column expression over one row of named values."""
    def run(expr, **values):
        schema = ", ".join(f"{k} {'int' if isinstance(v, int) or (v is None and k.startswith('i')) else 'double' if isinstance(v, float) else 'string'}"
                           for k, v in values.items())
        return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()["x"]
    return run
