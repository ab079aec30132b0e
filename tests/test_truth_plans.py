"""Truth triples are never sorted where they are read: a split of the small table unpivots to far more rows than it seems to hold."""

from attestry.operators import attributes as at

ROWS = [(2, "a>b", 1, "Size", "1.50", "in"), (1, "a>b", 2, "Size", "1-1/2", "Inches"), (1, "a>b", 3, "Size", "7 furlongs", "furlong"), (3, "a>c", 1, "Color", "", ""),
        (1, "a>b", 5, "Size", "2", "ft"), (4, "", 1, "Size", "3", "in"), (4, "a>c", 2, "", "3", "in")]


def long(spark):
    return spark.createDataFrame(ROWS, "row_no bigint, classpath string, slot int, label string, value string, uom string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_truth_attributes_are_dealt_before_they_are_grouped(spark):
    got = at.truth_attributes(long(spark))
    assert "Aggregate" not in plan(got).rsplit("Exchange", 1)[1]
    assert {tuple(r) for r in got.collect()} == {(1, "Size", "2", "ft"), (2, "Size", "1.50", "in"), (4, "Size", "3", "in")}
