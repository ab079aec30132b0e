import pytest
from oddrows import SCHEMA, rows


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for name in ("size", "weight", "times", "copy", "step", "odds", "spans", "fp", "component", "component_id", "toxic", "score", "digest",
                 "content", "held_out", "row", "place", "kept"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
