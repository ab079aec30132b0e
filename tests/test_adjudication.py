"""Candidates, conflicts and settlement on a few rows: what is read and shuffled, and what comes out."""

import re
import time

from attestry import session
from attestry.operators import adjudication as adj
from attestry.operators import verification as ver
from attestry.plans import q_verify
from attestry.plans.adapters import Tables

EXTRACTED = [(1, "Size", 0, "5 in", None, "description"), (1, "Size", 1, "5", "in", "manufacturer_site"), (1, "Color", 0, "Red", None, None),
             (2, "Size", 0, "5 in", None, "description"), (2, "Size", 1, "6 in", None, "manufacturer_site")]
NORMALIZED = [(1, "Size", 0, "5", "in", "description"), (1, "Size", 1, None, None, None), (1, "Color", 0, "red", None, None), (2, "Size", 1, "6", "in", "manufacturer_site")]
KIND = "item_id bigint, label string, idx int, value string, uom string, source_type string"


def test_a_measure_is_parsed_once_and_candidates_are_shuffled_once(spark):
    c = adj.candidates(spark.createDataFrame(EXTRACTED, KIND), spark.createDataFrame(NORMALIZED, KIND))
    assert "Union" not in c._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.item_id, r.label, r.candidate_id) for r in c.collect()) == [
        (1, "Color", "extracted:0"), (1, "Color", "normalized:0"), (1, "Size", "extracted:0"), (1, "Size", "extracted:1"), (1, "Size", "normalized:0"),
        (2, "Size", "extracted:0"), (2, "Size", "extracted:1"), (2, "Size", "normalized:1")]
    verdicts = spark.createDataFrame([(1, "Size", 7, "supported"), (1, "Size", 9, "ambiguous"), (2, "Size", 1, "supported"), (1, "Color", 3, "supported")],
                                     "item_id bigint, label string, pos bigint, entailment string")
    state = adj.conflicts(c, ver.first_verdicts(verdicts, spark.createDataFrame([(2,)], "item_id bigint")), "ambiguous")
    assert "regexp" not in state._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.item_id, r.label): (r.conflict, r.entailment, r.top_conflict) for r in state.collect()}
    assert rows == {(1, "Size"): (False, "supported", False), (1, "Color"): (False, "supported", False), (2, "Size"): (True, "ambiguous", False)}
    passed = {(r.item_id, r.label): r.candidate_id for r in adj.passthrough(c, state).collect()}
    assert passed == {(1, "Size"): "extracted:1", (1, "Color"): "normalized:0"}


def test_listed_candidates_are_those_of_the_join_and_shuffle_nothing(spark):
    e, n = spark.createDataFrame(EXTRACTED, KIND), spark.createDataFrame(NORMALIZED, KIND)
    rows = lambda df: sorted(map(str, df.collect()))
    out = adj.listed(e, n)
    assert rows(out) == rows(adj.candidates(e, n)) and out.columns == adj.candidates(e, n).columns
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_values_are_numbered_once_and_only_raw_lines_are_shuffled(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(q_verify.listed(t)) and "Join" not in plan(q_verify.listed(t))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(q_verify.listed(t)) == rows(adj.candidates(t.extracted, t.normalized))
    shuffle = next(x for x in t.by_order().extracted._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    assert "hashpartitioning(l_orderkey" in shuffle


def test_shuffles_go_with_the_write_that_made_them(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllBlocks().mkString(" ")))
    before = held()
    kept = session.stored(spark.range(1000).repartition(3), "range")
    for _ in range(50):         # files are removed in the background
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"     # for later queries as it was
