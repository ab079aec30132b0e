"""Spellings are counted as they are written and cleaned once each, not row by row."""

from attestry.operators import entities as en

RAW = ["Acme  Inc", "Acme Inc", "Acme Inc", " N/A ", None, "Acme Inc.", "ﬁne Co", "fine Co"]


def test_cleaning_reads_distinct_spellings(spark):
    raw = spark.createDataFrame([(v,) for v in RAW * 50], "value string").repartition(3)
    counted = en.cleaned_spellings(raw)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "nfkc" in plan       # the rows lie behind a written table
    got = {(r["value"], r["n"], r["key"]) for r in en.count_spellings(counted, []).collect()}
    assert got == {("Acme Inc", 150, "acme"), ("Acme Inc.", 50, "acme"), ("fine Co", 100, "fine")}


def test_leaders_are_assigned_on_written_counts(spark):
    counted = en.count_spellings(spark.createDataFrame([(v,) for v in ("Acme", "Acme", "Bolt")], "value string"), [])
    plan = en.assign_leaders(counted)._jdf.queryExecution().optimizedPlan().toString()
    assert "nfkc" not in plan and "count(" not in plan.lower()
