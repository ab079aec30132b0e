"""Queries over attribute tables and value constraint."""

from pyspark.sql import functions as F

from attestry.operators import attributes as at
from attestry.operators import taxonomy as tax
from attestry.operators.buckets import with_bucket
from attestry.plans.adapters import VIEWS, spread
from attestry.plans.q_units import d_unit, split_views
from attestry.plans.registry import FRAGMENTS, query
from attestry.session import scratch_path
from attestry.sources import reference as ref

FRAGMENTS["triples"] = " UNION ALL ".join(
    f"SELECT row_no, trim(classpath) AS classpath, {n} AS slot, trim(attribute_label_{n}) AS label, trim(attribute_value_{n}) AS value, trim(attribute_uom_{n}) AS uom FROM truth"
    for n in range(1, 7))
FRAGMENTS["triples_in"] = "SELECT row_no, slot, classpath, label, nullif(value, '') AS value, nullif(uom, '') AS uom FROM triples"
split_views("triples_in", "row_no, slot, classpath", tag="tr")


def triples(t):
    return at.unpivot_triples(spread(t.truth).withColumn("classpath", F.trim("classpath")), ["row_no", "classpath"], 6)


# the six triples of a row, dealt over all fifty slots of the delivery table
FRAGMENTS["dealt"] = "SELECT row_no, (slot - 1) * 8 + 1 + row_no % CASE slot WHEN 6 THEN 10 ELSE 8 END AS slot, label, value, uom FROM triples"


@query("src_delivery_csv", f"""SELECT CAST(s.slot AS INT) AS slot, count(*) FILTER (label <> '') AS labels, count(*) FILTER (label = '' AND value <> '') AS value_without_label,
 count(*) FILTER (uom <> '' AND {d_unit('uom')} IS NULL) AS unknown_unit FROM (SELECT unnest(range(1, 51)) AS slot) s LEFT JOIN dealt d ON d.slot = s.slot GROUP BY s.slot""")
def _(t):
    """Write the truth table as a delivery file of 252 columns, read it through the refusing reader, report its fifty slots."""
    at_slot = lambda n, k: F.when(F.col("row_no") % (10 if n == 6 else 8) == k, F.col("row_no"))
    names = {"MANUFACTURER_NAME": "manufacturer_name", "BRAND_NAME": "brand_name", "Classpath": "classpath", "UNSPSC": "unspsc", "Product Name": "product_name",
             "Country Of Origin": "country_of_origin", "MOBILE_DESC": "mobile_desc", "INVOICE_DESC": "invoice_desc", "SHORT_DESC": "short_desc", "LONG_DESC1": "long_desc1",
             "RETAIL_DESC": "retail_desc", "MARKETING_DESCRIPTION": "marketing_description", "PART_NUMBER": "row_no"}
    slots = []
    for n in range(1, 7):
        for k in range(10 if n == 6 else 8):
            slot = (n - 1) * 8 + 1 + k
            for part in ("label", "value", "uom"):
                slots.append(F.when(at_slot(n, k).isNotNull(), F.col(f"attribute_{part}_{n}")).alias(f"{part}{slot}"))
                names[f"ATTRIBUTE_{part.upper()} {slot}"] = f"{part}{slot}"
    path = scratch_path(t.spark, "delivery-truth")
    ref.write_delivery_csv(ref.delivery_rows(t.truth.select("*", *slots), names), path)
    back = ref.read_delivery_csv(t.spark, path)
    return at.slot_report(ref.delivery_triples(back, ["PART_NUMBER"]))


@query("agg_expected", "SELECT classpath, label, min(row_no * 100 + slot) AS seen FROM triples WHERE classpath <> '' AND label <> '' GROUP BY 1, 2")
def _(t):
    return at.expected_labels(triples(t)).select("classpath", "label", (F.col("seen.row_no") * 100 + F.col("seen.slot")).alias("seen"))


FRAGMENTS["vocab_rows"] = """SELECT classpath, label, CASE WHEN raw_value IS NOT NULL AND valid THEN value END AS value, CASE WHEN raw_value IS NOT NULL AND valid THEN uom END AS uom,
 min(row_no * 100 + slot) AS seen FROM tr_norm WHERE classpath <> '' AND label <> '' GROUP BY 1, 2, 3, 4"""
FRAGMENTS["vocab_truth"] = """SELECT * FROM vocab_rows v WHERE value IS NOT NULL OR NOT EXISTS (SELECT 1 FROM vocab_rows w WHERE w.classpath = v.classpath AND w.label = v.label AND w.value IS NOT NULL)"""


@query("agg_vocab", "SELECT classpath, label, value, uom, seen FROM vocab_truth")
def _(t):
    return at.value_vocabulary(triples(t)).withColumn("seen", F.col("seen.row_no") * 100 + F.col("seen.slot"))


@query("nrm_values", "SELECT row_no, v.label, v.value, v.uom FROM truth t JOIN vocab_truth v ON v.classpath = trim(t.classpath) WHERE v.value IS NOT NULL")
def _(t):
    vocab = at.value_vocabulary(triples(t)).where(F.col("value").isNotNull())
    return t.truth.select("row_no", F.trim("classpath").alias("classpath")).join(vocab, "classpath").select(
        "row_no", "label", "value", "uom")


@query("agg_product_name", """WITH c AS (SELECT trim(classpath) AS classpath, trim(product_name) AS product_name, count(*) AS n, min(row_no) AS f FROM truth WHERE trim(classpath) <> '' AND trim(product_name) <> '' GROUP BY 1, 2)
SELECT classpath, product_name, n FROM c QUALIFY row_number() OVER (PARTITION BY classpath ORDER BY n DESC, f) = 1""")
def _(t):
    return at.product_names(t.truth)


@query("agg_limits", """SELECT 80 AS mobile, 40 AS invoice, max(length(short_desc)) AS short, max(length(long_desc1)) AS long, max(length(retail_desc)) AS retail, max(length(marketing_description)) AS marketing FROM truth""")
def _(t):
    return at.length_limits(t.truth)


@query("aud_truth_attrs", f"SELECT row_no, label, value, {d_unit('uom')} AS uom FROM triples WHERE label <> '' AND value <> '' QUALIFY row_number() OVER (PARTITION BY row_no, label ORDER BY slot DESC) = 1")
def _(t):
    return at.truth_attributes(triples(t))


@query("cls_expected")
def _(t):
    have = t.truth.where("classpath <> ''").select(F.col("classpath").alias("path"))
    near = tax.nearest_path(t.loose_paths, have)
    return at.labels_or_generic(t.loose_paths, near, at.expected_labels(triples(t)))


VIEWS["lov_file"] = """
SELECT o_orderkey AS row_no, 'Lov>' || o_orderpriority AS category_path,
  CASE o_orderkey % 4 WHEN 0 THEN 'Size' WHEN 1 THEN ' Color ' WHEN 2 THEN 'Voltage' ELSE 'Empty' END AS attribute_name,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 30 AS STRING) || '.5' WHEN 1 THEN o_orderstatus WHEN 2 THEN CAST(o_custkey % 9 * 12 AS STRING) || ' volts' ELSE '' END AS lov_value,
  CASE o_orderkey % 12 WHEN 0 THEN 'inch' WHEN 4 THEN '"' WHEN 8 THEN 'furlong' ELSE '' END AS unit
FROM {orders}
"""
FRAGMENTS["lov_in"] = "SELECT row_no, trim(category_path) AS classpath, trim(attribute_name) AS label, nullif(trim(lov_value), '') AS value, nullif(trim(unit), '') AS uom FROM lov_file"
split_views("lov_in", "row_no, classpath", tag="lv")
FRAGMENTS["lov_rows"] = """SELECT classpath, label, CASE WHEN raw_value IS NOT NULL THEN value END AS value, CASE WHEN raw_value IS NOT NULL THEN uom END AS uom, raw_value IS NULL OR valid AS valid, min(row_no) AS seq FROM lv_norm GROUP BY 1, 2, 3, 4, 5"""


@query("src_lov", """SELECT * FROM lov_rows v WHERE value IS NOT NULL OR NOT EXISTS (SELECT 1 FROM lov_rows w WHERE w.classpath = v.classpath AND w.label = v.label AND w.value IS NOT NULL)""")
def _(t):
    return ref.allowed_values(t.lov_file)


@query("cls_lovs", """SELECT o_orderkey, p.label, p.vals FROM orders JOIN (SELECT classpath, label, string_agg(value, '|' ORDER BY seq) AS vals FROM lov_rows WHERE value IS NOT NULL AND valid GROUP BY 1, 2) p ON p.classpath = 'Lov>' || o_orderpriority""")
def _(t):
    maps = at.allowed_map(ref.allowed_values(t.lov_file).where("valid"))
    items = t.orders.select("o_orderkey", F.concat(F.lit("Lov>"), "o_orderpriority").alias("classpath"))
    return items.join(maps, "classpath").select("o_orderkey", F.explode("lovs").alias("label", "vals")).withColumn("vals", F.array_join("vals", "|"))


split_views("extracted", "item_id, idx", tag="ex")
FRAGMENTS["ex_path"] = "SELECT e.*, classpath FROM ex_norm e LEFT JOIN item_paths USING (item_id)"
FRAGMENTS["learned"] = """SELECT classpath, label, value, uom FROM ex_path e WHERE valid AND value <> '' AND classpath IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM allowed a WHERE a.classpath = e.classpath AND a.label = e.label) AND NOT EXISTS (SELECT 1 FROM closed c WHERE c.classpath = e.classpath AND c.label = e.label)
 QUALIFY row_number() OVER (PARTITION BY classpath, label ORDER BY item_id, idx) = 1"""


@query("win_first_seen", "SELECT classpath, label, value, uom FROM learned")
def _(t):
    n = at.normalize_extracted(t.extracted, t.item_paths)
    return at.learned_first(n, t.allowed, t.closed, ["item_id", "idx"])


@query("nrm_constrain")     # near matches need the weighted scorer: held against all pairs in tests/test_matching.py
def _(t):
    n = at.bucketed(at.normalize_extracted(t.extracted, t.item_paths), t.allowed, t.closed, ["item_id", "idx", "label"])
    return at.constrain(at.in_bucket(n), t.allowed, t.closed, ["item_id", "idx", "label"]).select("classpath", "label", "value", "uom", "match_value", "match_uom", "score")


@query("nrm_stage")
def _(t):
    return at.normalize_stage(t.extracted, t.item_paths, t.allowed, t.closed)


VIEWS["part_paths"] = """
SELECT p_partkey AS item_id, concat('Parts>', p_type, '>', p_name) AS classpath, p_brand AS label FROM {part}
"""
VIEWS["bucket_paths"] = """
SELECT DISTINCT concat('Parts>', p_type, '>', p_name) AS classpath, p_brand AS label FROM {part} WHERE p_size = 1
"""


@query("nrm_buckets")       # needs the weighted scorer: held against the row-by-row rule in tests/test_buckets.py
def _(t):
    served = with_bucket(t.part_paths, t.bucket_paths, ["item_id"], F.lit(True))
    return served.groupBy("classpath", "label", "bucket").agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"))


VIEWS["spelled_values"] = """
SELECT 'Orders>' || CAST(partkey % 3 AS STRING) AS classpath, label, value AS observed_value, uom AS observed_uom,
  (item_id * 8 + line) * 1048576 + partkey AS seq, CASE WHEN suppkey % 2 = 0 THEN 'trace' ELSE 'truth' END AS source,
  lower(value) AS value, CASE WHEN uom IN ('in', 'Inches', '"') THEN 'in' ELSE uom END AS uom
FROM {measures}
"""


@query("agg_snapshot", """WITH r AS (SELECT *, CASE WHEN source = 'trace' AND observed_value <> value AND observed_uom IS NOT DISTINCT FROM uom THEN 'fuzzy_collapse'
  WHEN observed_value <> value OR observed_uom IS DISTINCT FROM uom THEN 'uom_or_fraction_rule' ELSE 'first_seen_original' END AS reason FROM spelled_values),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY classpath, label, value, uom, observed_value, observed_uom ORDER BY seq, source, reason) = 1)
SELECT classpath, label, value, uom, string_agg(observed_value || '/' || coalesce(observed_uom, '') || '/' || source || '/' || reason, '|' ORDER BY seq, observed_value, observed_uom) AS aliases FROM f GROUP BY 1, 2, 3, 4""")
def _(t):
    return at.snapshot(t.spelled_values).withColumn("aliases", F.array_join(F.transform("aliases", lambda a: F.concat_ws(
        "/", a["value"], F.coalesce(a["uom"], F.lit("")), a["source"], a["reason"])), "|"))
