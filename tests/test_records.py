"""Worked examples for resolution, descriptions, audit and job state."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import auditing as au
from attestry.operators import description as ds
from attestry.operators import entities as en
from attestry.operators import evaluation as evl
from attestry.operators.sampling import diverse_sample
from attestry.streaming import firstseen


def test_conflicting_brands_resolve_to_nothing(spark):
    vocab = spark.createDataFrame([("Bosch", "bosch"), ("Makita", "makita")], "canonical_name string, key string")
    rows = spark.createDataFrame([(1, "Bosch"), (1, "Makita"), (2, "Bosch Inc"), (2, "bosch"), (3, "zzzz")], "row_no bigint, value string")
    got = {r["row_no"]: r for r in en.resolve_names(rows, vocab, 0.86).collect()}
    assert (got[1]["canonical_name"], got[1]["conflict"], len(got[1]["candidates"])) == (None, True, 2)
    assert (got[2]["canonical_name"], got[2]["confidence"], got[2]["conflict"]) == ("Bosch", 1.0, False)
    assert got[3]["canonical_name"] is None and not got[3]["conflict"]


def test_golden_descriptions(spark):
    items = spark.createDataFrame([(1, "Dishwasher", "Whirlpool", "Whirlpool", "WDTS7024RZ"), (2, "Dishwasher", None, None, "PDSH4816AF")],
                                  "item_id bigint, product_name string, brand string, manufacturer string, mpn string")
    attrs = [(1, "Series", "Eco Series", None), (1, "Mounting Type", "Built-in", None), (1, "Material", "Stainless Steel", None), (1, "Color", "Stainless Steel", None),
             (1, "Voltage Rating", "120", "V"), (1, "Amperage Rating", "10", "A"), (1, "Sound Level", "41", "dBA"),
             (2, "Series", "Professional Series", None), (2, "Number of Wash Cycles", "5", None), (2, "Voltage Rating", "120", "V"), (2, "Amperage Rating", "15", "A"),
             (2, "Mounting Type", "Leg", None), (2, "Depth With Door Open", "50-1/4", "in"), (2, "Sound Level", "47", "dBA"), (2, "Material", "Stainless Steel", None)]
    a = spark.createDataFrame(attrs, "item_id bigint, label string, value string, uom string")
    got = {r["item_id"]: r for r in ds.build(ds.with_attribute_map(items, a)).collect()}
    one = got[1]
    assert one["MOBILE_DESC"] == "Whirlpool, Dishwasher, Eco Series, WDTS7024RZ, Built-in Mounting"
    assert one["INVOICE_DESC"] == "DISHWASHER BLTLN SST SST 120V 10A 41DBA"
    assert one["SHORT_DESC"] == "Whirlpool Eco Series WDTS7024RZ Dishwasher, Built-in Mounting, Stainless Steel, Stainless Steel"
    assert one["RETAIL_DESC"] == "Eco Series Dishwasher, Built-in Mounting, Stainless Steel, Stainless Steel"
    assert one["MARKETING_DESCRIPTION"] is None and one["compliance"]["MOBILE_DESC"] and not one["compliance"]["MARKETING_DESCRIPTION"]
    assert got[2]["INVOICE_DESC"] == "DISHWASHER LEG 5 SST 120V 15A 50-1/4IN"


def test_skipped_parts_and_first_cut(spark):
    rows = spark.createDataFrame([(["long first part", "ab", "c"],), (["toolongpart here"],), ([],)], "p array<string>")
    got = [tuple(r["j"]) for r in rows.select(ds.join_within(F.col("p"), ", ", 6).alias("j")).collect()]
    assert got == [("ab, c", True), ("toolon", True), ("", False)]


def test_percent_is_half_even_and_null_without_base(spark):
    rows = spark.createDataFrame([(9, 11), (2, 3), (0, 0), (1, 800)], "a int, b int")
    assert [r[0] for r in rows.select(au.percent(F.col("a"), F.col("b"))).collect()] == [81.82, 66.67, None, 0.12]


def test_macro_means_ignore_null(spark):
    rows = spark.createDataFrame([(1, "brand", 100.0), (2, "brand", 50.0), (1, "classpath", None), (2, "classpath", None)], "row_no bigint, group string, percent double")
    assert {r["group"]: r["percent"] for r in au.macro_accuracy(rows).collect()} == {"brand": 75.0, "classpath": None}


def test_job_states(spark):
    rows = spark.createDataFrame([(1, "completed"), (1, "failed"), (2, "pending"), (3, "completed"), (4, "completed"), (4, "pending")], "job int, state string")
    got = {r["job"]: r["status"] for r in evl.job_status(rows, "job").collect()}
    assert got == {1: "completed_with_errors", 2: "queued", 3: "completed", 4: "running"}


def test_first_seen_grows_across_batches(spark, tmp_path):
    schema = "b string, v string, o int"
    for i, rows in enumerate([[("x", "1", 5), ("x", "0", 3)], [("x", "9", 1), ("y", "2", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    firstseen.grow(spark, src, ["b"], ["v"], ["o"], str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["b"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["y"] == "2" and got["x"] in ("0", "9") and len(got) == 2


@pytest.mark.parametrize("pool", [1000, 25, 3])
def test_diverse_sample_equals_rescoring_everything(spark, pool):
    """Greedy picks of the whole table after every pick, whatever the pool that a round holds."""
    rng = random.Random(21)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(stock) for _ in range(rng.randint(2, 25))), rng.choice((None, "m1", "m2", "m3"))) for i in range(150)]
    words = {i: set(t.split()) for i, t, _ in rows if len(t.strip()) >= 22}
    df = {w: sum(w in own for own in words.values()) for w in stock}
    weight = {w: math.log((len(words) + 1) / (n + 1)) + 1 for w, n in df.items()}
    norm = {i: math.sqrt(sum(weight[w] ** 2 for w in own)) for i, own in words.items()}
    picks, used = [], set()
    for _ in range(12):
        score = {}
        for i, text, maker in rows:
            if i in words and i not in picks:
                sim = max((sum(weight[w] ** 2 for w in words[i] & words[p]) / norm[i] / norm[p] for p in picks), default=0.0)
                score[i] = round(1 - sim + 0.25 * min(len(text) / 100, 1) + (0.2 if (maker or "") not in used else 0), 9)
        best = min(score, key=lambda i: (-score[i], i))
        picks.append(best)
        used.add(rows[best][2] or "")
    got = diverse_sample(spark.createDataFrame(rows, "item_id bigint, text string, maker string"), 12, pool=pool).orderBy("pick").collect()
    assert [r["item_id"] for r in got] == picks


def test_diverse_sample_takes_few_rounds(spark):
    """Thirty picks of a thousand documents in a handful of jobs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id as item_id", "text", "source as maker")
    group = "diverse-sample"
    spark.sparkContext.setJobGroup(group, group)
    assert diverse_sample(docs, 30, pool=2000).count() == 30
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 40
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
