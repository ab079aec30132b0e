"""Labels in first-seen order, without a sort of all rows."""

from attestry.operators import attributes as at


def test_first_seen_labels_are_hashed(spark):
    rows = [("a", "Size", 9, 1), ("a", "Size", 3, 6), ("a", "Size", 3, 2), ("a", "Color", 3, 1), ("", "Size", 1, 1), ("b", "", 1, 1), ("b", "Size", 2 ** 40, 50)]
    out = at.expected_labels(spark.createDataFrame(rows, "classpath string, label string, row_no bigint, slot int"))
    assert sorted((r.classpath, r.label, r.seen.row_no, r.seen.slot) for r in out.collect()) == [("a", "Color", 3, 1), ("a", "Size", 3, 2), ("b", "Size", 2 ** 40, 50)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
