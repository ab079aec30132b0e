import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attestry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "attestry-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over literal rows: values(fn, rows) -> list."""

    def run(fn, rows, names=("a", "b", "c")):
        from pyspark.sql import functions as F

        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        cols = names[:len(rows[0])]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in cols))
        out = df.select("i", fn(*[F.col(c) for c in cols]).alias("x")).orderBy("i").collect()
        return [r["x"] for r in out]

    return run
