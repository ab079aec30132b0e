"""Delivery rows number the attributes of an item once; their gated columns do not read them."""

from pyspark.sql import functions as F

from attestry.operators import delivery as dl
from attestry.plans import q_describe
from attestry.plans.adapters import Tables
from attestry.sources import reference as ref

FOLDER = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attributes_are_numbered_once(spark):
    t = Tables(spark, FOLDER)
    assert "Window" not in optimized(q_describe.gated(t))
    slots = q_describe.slots(t)
    assert "Window" not in optimized(slots)
    status = q_describe.audit_status(t, q_describe.ds.field_rows(q_describe.described(t)))
    assert status.where("field like 'attribute:%'").count() == t.item_labels.count() == slots.count() > 0


def test_slots_are_judged_in_their_row_and_gates_shuffle_no_status(spark):
    t = Tables(spark, FOLDER)
    status = q_describe.audit_status(t, q_describe.ds.field_rows(q_describe.described(t)))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(q_describe.slots(t)) == rows(q_describe.dl.slot_rows(t.item_labels, t.finals, status, t.checked))
    assert optimized(q_describe.slots(t)).count("Join LeftOuter") == 2
    assert "inline" not in optimized(q_describe.gated(t)) and "Union" not in optimized(q_describe.gated(t))


def test_delivery_is_packed_and_cells_are_spread_after_the_joins(spark, tmp_path):
    wide = spark.range(30).select(*[F.col("id").cast("string").alias(c) for c in ref.DELIVERY_COLUMNS])
    ref.write_delivery_csv(wide.coalesce(1), str(tmp_path / "d"), compression="gzip")
    files = list((tmp_path / "d").glob("*.csv.gz"))
    assert files and sum(f.stat().st_size for f in files) * 5 < 30 * 252 * 3
    assert sorted(map(tuple, ref.read_delivery_csv(spark, str(tmp_path / "d")).collect())) == sorted(map(tuple, wide.collect()))
    slots = spark.createDataFrame([(1, 1, "Size", "5", "in"), (1, 50, "Color", " ", None)], "item_id bigint, slot int, label string, value string, uom string")
    cells = dl.slot_maps(slots).select("item_id", *dl.slot_cells())
    assert cells.collect() == dl.wide_slots(slots).collect() and len(cells.columns) == 151
    assert cells.first()["attribute_label_50"] == "Color" and cells.first()["attribute_value_50"] is None
