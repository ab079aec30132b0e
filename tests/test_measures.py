"""Measures are parsed once each, behind a written table, wherever rows repeat them."""

from attestry.operators import attributes as at
from attestry.operators import verification as ver

ROWS = [(1, "Size", 0, "5 in", None, "description"), (2, "Size", 0, "5 in", None, None), (3, "Size", 0, "5", "furlong", None), (4, "Size", 0, None, None, None),
        (5, "Weight", 0, "2.5", "lb", None)]
KIND = "item_id bigint, label string, idx int, value string, uom string, source_type string"
TRIPLES = [(2, "a>b", 1, "Size", "1.50", "in"), (1, "a>b", 2, "Size", "1-1/2", "Inches"), (1, "a>b", 3, "Size", "7", "furlong"), (3, "a>c", 1, "Color", "", ""),
           (1, "a>b", 5, "Size", "2", "ft"), (4, "", 1, "Size", "3", "in")]


def parses(df):
    return "regexp" in df._jdf.queryExecution().optimizedPlan().toString()


def test_extracted_values_are_parsed_once(spark):
    paths = spark.createDataFrame([(1, "p"), (2, "p")], "item_id bigint, classpath string")
    got = at.normalize_extracted(spark.createDataFrame(ROWS, KIND), paths)
    assert not parses(got)
    assert sorted((r.item_id, r.classpath, r.raw_value, r.value, r.uom, r.valid) for r in got.collect()) == [
        (1, "p", "5 in", "5", "in", True), (2, "p", "5 in", "5", "in", True), (3, None, "5", "5", None, False), (4, None, None, "", None, False), (5, None, "2.5", "2.5", "lb", True)]


def test_compliance_parses_once(spark):
    normalized = spark.createDataFrame([(1, "Size", 0, "5", "in"), (2, "Size", 0, "5", "ft"), (5, "Weight", 0, None, None)], "item_id bigint, label string, idx int, value string, uom string")
    got = ver.compliance(spark.createDataFrame(ROWS, KIND), normalized)
    assert not parses(got)
    assert sorted((r.item_id, r.vocabulary_compliant, r.uom_compliant) for r in got.collect()) == [
        (1, True, True), (2, True, False), (3, False, False), (4, False, True), (5, False, True)]


def test_vocabulary_is_counted_before_it_is_parsed(spark):
    got = at.value_vocabulary(spark.createDataFrame(TRIPLES, "row_no bigint, classpath string, slot int, label string, value string, uom string"))
    assert not parses(got)
    assert {(r.classpath, r.label, r.value, r.uom, r.seen.row_no, r.seen.slot) for r in got.collect()} == {
        ("a>b", "Size", "1-1/2", "in", 1, 2), ("a>b", "Size", "2", "ft", 1, 5), ("a>c", "Color", None, None, 3, 1)}
