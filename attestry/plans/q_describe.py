"""Queries over descriptions, audit status, delivery rows and nested sinks."""

from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.operators import auditing as au
from attestry.operators import delivery as dl
from attestry.operators import description as ds
from attestry.plans.adapters import VIEWS
from attestry.plans.q_text import d_fold, d_key
from attestry.plans.registry import FRAGMENTS, query
from attestry.session import cut_lineage, scratch_path, stored
from attestry.sources import catalog as src
from attestry.sources import reference as ref

LIMITS = {"MOBILE_DESC": 80, "INVOICE_DESC": 40, "SHORT_DESC": 60, "LONG_DESC1": 100, "RETAIL_DESC": 50}

VIEWS["desc_items"] = """
SELECT o_orderkey AS item_id, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'Commercial Undercounter Glass and Dish Washing Machine with Booster' ELSE 'Dishwasher' END AS product_name,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Brand ' || CAST(o_custkey % 20 AS STRING) END AS brand,
  CASE o_orderkey % 3 WHEN 0 THEN 'BRAND ' || CAST(o_custkey % 20 AS STRING) || ', Inc.' WHEN 1 THEN 'Maker ' || CAST(o_custkey % 9 AS STRING) ELSE NULL END AS manufacturer,
  'MX' || CAST(o_orderkey AS STRING) AS mpn FROM {orders}
"""
VIEWS["desc_attrs"] = """
SELECT item_id, label, value, CASE label WHEN 'Voltage Rating' THEN 'V' WHEN 'Sound Level' THEN 'dBA' WHEN 'Depth With Door Open' THEN 'in' ELSE NULL END AS uom
FROM (SELECT item_id, label, max(value) AS value FROM (SELECT l_orderkey AS item_id,
  CASE l_linenumber WHEN 1 THEN 'Mounting Type' WHEN 2 THEN 'Number of Wash Cycles' WHEN 3 THEN 'Material' WHEN 4 THEN 'Color' WHEN 5 THEN 'Voltage Rating'
    WHEN 6 THEN CASE l_orderkey % 2 WHEN 0 THEN 'Depth With Door Open' ELSE 'Sound Level' END ELSE 'Series' END AS label,
  CASE l_linenumber WHEN 1 THEN CASE l_partkey % 2 WHEN 0 THEN 'Built-In' ELSE 'Leg' END WHEN 3 THEN CASE l_partkey % 3 WHEN 0 THEN 'Stainless Steel' ELSE 'Black painted steel' END
    WHEN 4 THEN CASE l_suppkey % 3 WHEN 0 THEN 'Stainless Steel' ELSE 'White' END WHEN 7 THEN 'Series ' || l_returnflag ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS value
  FROM {lineitem}) x GROUP BY item_id, label) y
"""


# ---- check-side expressions ----------------------------------------------------------------

def d_measure(v, u):
    return f"CASE WHEN {u} IS NOT NULL AND {u} <> '' THEN {v} || ' ' || {u} ELSE {v} END"


def d_compact(label, v, u):
    return (f"CASE WHEN {v} IS NULL THEN '' WHEN {d_fold(v)} = 'built-in' THEN 'BLTLN' WHEN {d_fold(v)} = 'stainless steel' THEN 'SST' WHEN {label} = 'Number of Wash Cycles' THEN {v} "
            f"ELSE upper(replace({d_measure(v, u)}, ' ', '')) END")


def d_phrase(label, v, u, style):
    m = d_measure(v, u)
    cyc = "-Wash Cycle" if style in ("short", "retail") else " Wash Cycles"
    return (f"CASE WHEN {v} IS NULL THEN '' WHEN {label} IN ('Series', 'Material', 'Color', 'Size') THEN {m} WHEN {label} = 'Number of Wash Cycles' THEN {m} || '{cyc}' "
            f"WHEN {label} = 'Mounting Type' THEN {m} || ' Mounting' WHEN {label} = 'Additional Information' THEN 'Additional Information: ' || {m} ELSE {m} || ' ' || {label} END")


def d_join(parts, sep, limit):
    longer = f"CASE WHEN acc.t = '' THEN p ELSE acc.t || '{sep}' || p END"
    fold = (f"list_reduce(u, lambda acc, p: CASE WHEN length({longer}) <= {limit} THEN {{'t': {longer}, 'x': acc.x}} ELSE {{'t': acc.t, 'x': true}} END, {{'t': '', 'x': false}})")
    return (f"(SELECT CASE WHEN j.t <> '' THEN j ELSE {{'t': rtrim(left(coalesce(u[1], ''), {limit})), 'x': length(coalesce(u[1], '')) > {limit}}} END FROM (SELECT u, {fold} AS j "
            f"FROM (SELECT list_filter(list_transform({parts}, lambda q: trim(q)), lambda q: length(q) > 0) AS u) u1) u2)")


@query("dsc_compact", f"SELECT item_id, label, {d_compact('label', 'value', 'uom')} AS text FROM desc_attrs")
def _(t):
    return t.desc_attrs.select("item_id", "label", ds.compact(F.col("label"), F.col("value"), F.col("uom")).alias("text"))


@query("dsc_phrase", f"SELECT item_id, label, {d_phrase('label', 'value', 'uom', 'short')} AS short, {d_phrase('label', 'value', 'uom', 'long')} AS long FROM desc_attrs")
def _(t):
    c = (F.col("label"), F.col("value"), F.col("uom"))
    return t.desc_attrs.select("item_id", "label", ds.phrase(*c, "short").alias("short"), ds.phrase(*c, "long").alias("long"))


_BUDGET = "[brand, product_name, '', mpn, manufacturer, 'x']"


@query("dsc_budget", f"SELECT item_id, j.t AS text, j.x AS truncated FROM (SELECT item_id, {d_join(_BUDGET, ', ', 24)} AS j FROM desc_items) z")
def _(t):
    parts = F.array("brand", "product_name", F.lit(""), "mpn", "manufacturer", F.lit("x"))
    return t.desc_items.select("item_id", ds.join_within(parts, ", ", 24).alias("j")).select("item_id", "j.text", "j.truncated")


_LABELS = list(dict.fromkeys([*fv.INVOICE_ORDER, *fv.LONG_ORDER, "Series"]))
_N = {lab: f"v{i}" for i, lab in enumerate(_LABELS)}
FRAGMENTS["desc_pivot"] = "SELECT i.*, " + ", ".join(
    f"max(a.value) FILTER (a.label = '{lab}') AS {n}, max(a.uom) FILTER (a.label = '{lab}') AS u{n}" for lab, n in _N.items()
) + " FROM desc_items i LEFT JOIN desc_attrs a USING (item_id) GROUP BY ALL"


def _ph(label, style):
    return d_phrase(f"'{label}'", _N[label], "u" + _N[label], style)


def _cp(label):
    return d_compact(f"'{label}'", _N[label], "u" + _N[label])


_S = _N["Series"]
_IDENT = f"CASE WHEN manufacturer IS NOT NULL AND brand IS NOT NULL AND {d_key('manufacturer')} <> {d_key('brand')} THEN manufacturer || ' ' || brand ELSE coalesce(brand, manufacturer) END"
_TAILS = f"CASE WHEN {_N['Number of Wash Cycles']} IS NOT NULL THEN {_cp('Depth With Door Open')} ELSE {_cp('Sound Level')} END"
_PARTS = {
    "MOBILE_DESC": (f"[{_IDENT}, product_name, {_S}, mpn, {_ph('Mounting Type', 'mobile')}]", ", "),
    "INVOICE_DESC": ("[upper(product_name), " + ", ".join(_cp(x) for x in fv.INVOICE_ORDER) + f", {_TAILS}]", " "),
    "SHORT_DESC": (f"[concat_ws(' ', brand, {_S}, mpn, product_name), " + ", ".join(_ph(x, "short") for x in fv.SHORT_ORDER) + "]", ", "),
    "LONG_DESC1": (f"[concat_ws(' ', brand, product_name), {_S}, " + ", ".join(_ph(x, "long") for x in fv.LONG_ORDER) + "]", ", "),
    "RETAIL_DESC": (f"[concat_ws(' ', {_S}, product_name), " + ", ".join(_ph(x, "retail") for x in fv.SHORT_ORDER) + "]", ", "),
}
FRAGMENTS["described"] = "SELECT item_id, product_name, " + ", ".join(f"{d_join(p, sep, LIMITS[f])} AS {f}" for f, (p, sep) in _PARTS.items()) + " FROM desc_pivot"
FRAGMENTS["desc_long"] = " UNION ALL ".join(
    f"SELECT item_id, '{f}' AS field, nullif({f}.t, '') AS value, {f}.t <> '' AND length({f}.t) >= {60 if f == 'MOBILE_DESC' else 0} AND length({f}.t) <= {LIMITS[f]} AS compliant FROM described" for f in _PARTS
) + " UNION ALL SELECT item_id, 'MARKETING_DESCRIPTION', NULL, false FROM described"


def described(t):
    return ds.build(ds.with_attribute_map(t.desc_items, t.desc_attrs), LIMITS)


@query("dsc_build", "SELECT item_id, " + ", ".join(f"nullif({f}.t, '') AS {f}" for f in _PARTS) + " FROM described")
def _(t):
    return described(t).select("item_id", *_PARTS)


@query("dsc_comply", "SELECT item_id, 'description_missing_product_name' AS code, 'Product Name' AS field FROM described WHERE product_name IS NULL UNION ALL SELECT item_id, 'mobile_description_below_target', 'MOBILE_DESC' FROM described WHERE MOBILE_DESC.t <> '' AND length(MOBILE_DESC.t) < 60 UNION ALL "
       + " UNION ALL ".join(f"SELECT item_id, 'description_truncated', '{f}' FROM described WHERE {f}.x" for f in _PARTS)
       + " UNION ALL SELECT item_id, 'compliant', field FROM desc_long WHERE compliant")
def _(t):
    d = described(t)
    flags = d.select("item_id", F.inline("desc_flags"))
    return flags.unionByName(ds.field_rows(d).where("compliant").select("item_id", F.lit("compliant").alias("code"), "field"))


# ---- audit -----------------------------------------------------------------------------------

VIEWS["audit_base"] = """
SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Maker' END AS manufacturer, CASE o_orderkey % 4 WHEN 0 THEN 0.65 ELSE 0.98 END AS manufacturer_confidence,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Brand' END AS brand, CASE o_orderkey % 6 WHEN 0 THEN 0.5 ELSE 1.0 END AS brand_confidence,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Orders>' || o_orderpriority || '>' || o_orderstatus END AS classpath, CASE o_orderkey % 3 WHEN 0 THEN 0.41 ELSE 0.9 END AS class_confidence
FROM {orders}
"""
VIEWS["path_labels"] = """
SELECT classpath, label, row_number() OVER (PARTITION BY classpath ORDER BY label DESC) AS slot FROM (
  SELECT DISTINCT p.classpath AS classpath, e.label AS label FROM {extracted} e JOIN {item_paths} p ON p.item_id = e.item_id WHERE p.classpath IS NOT NULL) x
"""
VIEWS["item_labels"] = """SELECT p.item_id AS item_id, l.label AS label, CAST(l.slot AS INT) AS slot FROM {item_paths} p JOIN {path_labels} l ON l.classpath = p.classpath"""
VIEWS["finals"] = """SELECT item_id, label, CASE WHEN item_id % 9 = 0 THEN NULL ELSE value END AS value, uom, source_type FROM {extracted} WHERE idx = 0 AND item_id % 6 <> 0"""
VIEWS["checked"] = """
SELECT item_id, label, CASE WHEN (item_id + length(label)) % 5 = 0 THEN 'ambiguous' ELSE 'supported' END AS entailment, CASE WHEN item_id % 8 = 0 THEN 0.7 ELSE 0.9 END AS confidence,
  (item_id + length(label)) % 4 <> 0 AS vocabulary_compliant, (item_id + length(label)) % 11 <> 0 AS uom_compliant FROM {extracted} WHERE idx = 0
"""
FRAGMENTS["status"] = """SELECT item_id, 'manufacturer' AS field, coalesce(manufacturer IS NOT NULL AND manufacturer_confidence >= 0.86, false) AS okay FROM audit_base
UNION ALL SELECT item_id, 'brand', coalesce(brand IS NOT NULL AND brand_confidence >= 0.86, false) FROM audit_base UNION ALL SELECT item_id, 'classpath', coalesce(classpath IS NOT NULL AND class_confidence >= 0.42, false) FROM audit_base
UNION ALL SELECT x.item_id, 'attribute:' || x.label, coalesce(f.value IS NOT NULL AND c.entailment = 'supported' AND c.confidence >= 0.8 AND c.vocabulary_compliant AND c.uom_compliant, false)
  FROM item_labels x LEFT JOIN finals f ON f.item_id = x.item_id AND f.label = x.label LEFT JOIN checked c ON c.item_id = x.item_id AND c.label = x.label
UNION ALL SELECT item_id, 'description:' || field, value IS NOT NULL AND compliant FROM desc_long"""


def audit_status(t, fields=None, labels=None):
    labels = t.item_labels.select("item_id", "label") if labels is None else labels
    return au.status_rows(t.audit_base, labels, t.finals, t.checked, fields or ds.field_rows(described(t)))


@query("aud_status", "SELECT item_id, field, okay FROM status")
def _(t):
    return audit_status(t)


@query("aud_percent", """WITH s AS (SELECT item_id, count(*) FILTER (okay) AS resolved, count(*) AS total FROM status GROUP BY 1),
a AS (SELECT x.item_id, count(*) AS expected, count(e.label) AS produced, count(CASE WHEN e.label IS NOT NULL AND n.label IS NOT NULL THEN 1 END) AS vt, count(CASE WHEN e.label IS NOT NULL AND n.label IS NOT NULL AND c.vocabulary_compliant THEN 1 END) AS vo
  FROM item_labels x LEFT JOIN (SELECT DISTINCT item_id, label FROM extracted WHERE value IS NOT NULL) e ON e.item_id = x.item_id AND e.label = x.label LEFT JOIN (SELECT DISTINCT item_id, label FROM normalized) n ON n.item_id = x.item_id AND n.label = x.label LEFT JOIN checked c ON c.item_id = x.item_id AND c.label = x.label GROUP BY 1),
d AS (SELECT item_id, count(value) AS dt, count(*) FILTER (value IS NOT NULL AND compliant) AS dk FROM desc_long GROUP BY 1)
SELECT s.item_id, resolved, total, round_even(100.0 * resolved / total, 2)::DOUBLE AS coverage_percent, round_even(100.0 * vo / nullif(vt, 0), 2)::DOUBLE AS vocabulary_percent, coalesce(vt, 0) AS vocab_total,
 round_even(100.0 * produced / nullif(expected, 0), 2)::DOUBLE AS attribute_percent, coalesce(produced, 0) AS produced, coalesce(expected, 0) AS expected, round_even(100.0 * dk / nullif(dt, 0), 2)::DOUBLE AS character_percent, dk AS desc_ok, dt AS desc_total
FROM s LEFT JOIN a USING (item_id) LEFT JOIN d USING (item_id)""")
def _(t):
    fields = cut_lineage(ds.field_rows(described(t)))
    return au.percentages(audit_status(t, fields), t.item_labels.select("item_id", "label"), t.extracted,
                          t.normalized, t.checked, fields)


FRAGMENTS["routes"] = "SELECT s.item_id, bool_or(NOT okay) OR coalesce(bool_or(b.o), false) AS routed FROM status s LEFT JOIN (SELECT o_orderkey AS item_id, o_custkey % 17 = 0 AS o FROM orders) b USING (item_id) GROUP BY 1"


def routed(t, status=None):
    asked = t.orders.select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 17 == 0).alias("needs_review"))
    return au.route(audit_status(t) if status is None else status, asked)


@query("aud_route", "SELECT * FROM routes")
def _(t):
    return routed(t)


@query("rev_queue", r"""SELECT s.item_id, field, CASE WHEN field LIKE 'attribute:%' THEN substr(field, 11) || ' lacks supported, confident, vocabulary-compliant evidence.'
 WHEN field LIKE 'description:%' THEN substr(field, 13) || ' is blank or outside its character requirements.' ELSE upper(left(field, 1)) || substr(field, 2) || ' is unresolved or low confidence.' END AS message
FROM status s JOIN routes r ON r.item_id = s.item_id AND r.routed WHERE NOT okay""")
def _(t):
    status = cut_lineage(audit_status(t))       # read twice
    return au.review_queue(routed(t, status), au.flag_rows(status))


# ---- delivery -----------------------------------------------------------------------------------

@query("out_source", "SELECT row_no, " + ", ".join(f"CASE WHEN trim({c}) <> '' THEN {c} END AS {c}" for c in dl.SOURCE_FIELDS) + ", mfg_part_num AS manufacturer_part_number FROM catalog")
def _(t):
    return dl.source_columns(t.catalog, "row_no")


VIEWS["class_codes"] = "SELECT o_orderkey AS item_id, CAST(10000000 + o_orderkey % 80000000 AS STRING) AS code FROM {orders}"
VIEWS["sent_rows"] = """
SELECT item_id, mpn AS mfg_part_num, product_name AS part_desc, brand AS e1_brand, CASE item_id % 3 WHEN 0 THEN '-- Unbranded --' WHEN 1 THEN ' ' ELSE NULL END AS unilog_brand,
  CAST(NULL AS STRING) AS dib_brand, manufacturer AS part_manuf FROM {desc_items}
"""
_GATED = {"manufacturer": "manufacturer", "brand": "brand", "classpath": "classpath", "code": "classpath", **{f: f"description:{f}" for f in _PARTS}, "product_name": None}
FRAGMENTS["gates"] = "SELECT item_id, " + ", ".join(f"bool_or(okay) FILTER (field = '{g}') AS \"{g}\"" for g in dict.fromkeys(g for g in _GATED.values() if g)) + " FROM status GROUP BY item_id"
_GATED_FROM = {f: f"nullif({f}.t, '')" for f in _PARTS} | {"manufacturer": "b.manufacturer", "brand": "b.brand", "classpath": "b.classpath", "code": "k.code"}
FRAGMENTS["gated"] = "SELECT b.item_id, " + ", ".join(
    f"CASE WHEN g.\"{g}\" THEN {_GATED_FROM.get(c, c)} END AS {c}" for c, g in _GATED.items() if g) + """, d.product_name
FROM audit_base b JOIN class_codes k ON k.item_id = b.item_id JOIN described d ON d.item_id = b.item_id JOIN gates g ON g.item_id = b.item_id"""


def gated(t):
    """The gated columns: each passes its gate in the row that it comes from, so no status is shuffled.  No column waits for an
    attribute's status."""
    texts = {c: g for c, g in _GATED.items() if c in _PARTS or c == "product_name"}
    said = F.map_from_entries(F.transform(ds.fields(), lambda r: au.description_status(r["field"], r["value"], r["compliant"])))
    names = dl.gated_columns(t.audit_base.join(t.class_codes, "item_id"), F.map_from_entries(au.entity_status()), {c: g for c, g in _GATED.items() if c not in texts})
    return names.join(dl.gated_columns(described(t), said, texts), "item_id").select("item_id", *_GATED)


@query("out_gated", "SELECT * FROM gated")
def _(t):
    return gated(t)


FRAGMENTS["slots"] = """SELECT x.item_id, x.slot, x.label, CASE WHEN s.okay THEN f.value END AS value, CASE WHEN s.okay THEN f.uom END AS uom, CASE WHEN s.okay THEN f.source_type END AS source_type, CASE WHEN s.okay THEN c.confidence END AS confidence
FROM item_labels x LEFT JOIN finals f ON f.item_id = x.item_id AND f.label = x.label LEFT JOIN status s ON s.item_id = x.item_id AND s.field = 'attribute:' || x.label LEFT JOIN checked c ON c.item_id = x.item_id AND c.label = x.label"""


def slots(t):
    """Values and verdicts come from attributes that are numbered and written once; a first value has one verdict, so its status is
    judged in its row."""
    t = t.by_order().hold(extracted=["item_id", "label", "idx", "value", "uom", "source_type"])
    t = t.hold(path_labels=["classpath", "label", "slot"])
    return dl.judged_slots(t.item_labels, t.finals, t.checked)


@query("win_slots", "SELECT * FROM slots")
def _(t):
    return slots(t)


_WIDE = ", ".join(f"max({f}) FILTER (slot = {i}) AS attribute_{f}_{i}" for i in range(1, 51) for f in ("label", "value", "uom"))


@query("out_slots", f"SELECT item_id, {_WIDE} FROM slots GROUP BY item_id")
def _(t):
    return dl.wide_slots(slots(t))


@query("out_provenance", """SELECT s.item_id, 'attribute_label_' || slot AS field, 'classify' AS stage, b.class_confidence AS confidence, NULL AS source_type FROM slots s JOIN audit_base b USING (item_id)
UNION ALL SELECT item_id, 'attribute_value_' || slot, 'adjudicate', confidence, source_type FROM slots WHERE value <> '' UNION ALL SELECT item_id, 'attribute_uom_' || slot, 'adjudicate', confidence, source_type FROM slots WHERE uom <> ''""")
def _(t):
    return dl.provenance_rows(slots(t), t.audit_base.select("item_id", "class_confidence"))


#: delivery field -> column of the wide rows
_FIELDS = {**{c: c.lower() for c in fv.CATALOG_COLUMNS}, "MANUFACTURER_PART_NUMBER": "manufacturer_part_number", "MANUFACTURER_NAME": "manufacturer", "BRAND_NAME": "brand",
           "Classpath": "classpath", "UNSPSC": "code", "Product Name": "product_name", **{f: f for f in _PARTS},
           **{f"ATTRIBUTE_{f.upper()} {i}": f"attribute_{f}_{i}" for i in range(1, 51) for f in ("label", "value", "uom")}}
FRAGMENTS["slots_wide"] = f"SELECT item_id, {_WIDE} FROM slots GROUP BY item_id"
_SENT = ", ".join(f"CASE WHEN trim({c}) <> '' THEN {c} END AS {c}" for c in dl.SOURCE_FIELDS)


@query("snk_delivery", "SELECT " + ", ".join(f"coalesce({_FIELDS[c]}, '') AS \"{c}\"" if c in _FIELDS else f"'' AS \"{c}\"" for c in ref.DELIVERY_COLUMNS) +
       f" FROM (SELECT item_id, {_SENT}, CASE WHEN trim(mfg_part_num) <> '' THEN mfg_part_num END AS manufacturer_part_number FROM sent_rows) s JOIN gated USING (item_id) LEFT JOIN slots_wide USING (item_id)")
def _(t):
    """The whole delivery table, 252 columns in their order, written under its contract and read back by the refusing reader."""
    held = stored(slots(t), "slots")
    rows = dl.source_columns(t.sent_rows).join(stored(gated(t), "gated"), "item_id").join(dl.slot_maps(held), "item_id", "left")
    wide = rows.select(*[c for c in rows.columns if c != "slots"], *dl.slot_cells())      # cells are spread after the joins
    path = scratch_path(t.spark, "delivery")
    ref.write_delivery_csv(ref.delivery_rows(wide, _FIELDS), path, compression="gzip")    # most of a row is empty quoted cells
    return ref.read_delivery_csv(t.spark, path)


# ---- nested records ---------------------------------------------------------------------------

def nested(t):
    r = t.records
    s = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    attr = lambda label, value: s(label=F.lit(label), value=value)
    return r.select(
        "event_id", "item_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), s(mfg_part_num=F.col("mpn")).alias("input"),
        s(manufacturer=s(canonical_name=F.concat(F.lit("Maker \"Q\", "), F.col("state"))), brand=s(canonical_name=F.when(F.col("routed"), F.col("item_id"))),
          cache_hit=F.col("cache_hit")).alias("brand_resolution"),
        s(code=F.col("code"), confidence=F.col("confidence")).alias("classify"), s(invoked=F.col("adjudicated")).alias("adjudicate"),
        s(attributes=F.array(attr("Size", F.col("mpn")), attr("Color", F.col("state")))).alias("extract"),
        s(results=F.array(s(label=F.lit("Color"), entailment=F.when(F.col("routed"), "ambiguous").otherwise("supported"), confidence=F.col("confidence")))).alias("verify"),
        s(routed_to_review=F.col("routed"), flags=F.when(F.col("routed"), F.array(s(field=F.lit("brand")))).otherwise(F.array().cast("array<struct<field:string>>"))).alias("audit"))


@query("snk_trace_json", "SELECT event_id, item_id, mpn, code, confidence, routed FROM records")
def _(t):
    df = nested(t)
    path = scratch_path(t.spark, "trace-json")
    df.write.json(path)
    back = t.spark.read.schema(df.schema).json(path)
    return back.select("event_id", "item_id", F.col("input.mfg_part_num").alias("mpn"), "classify.code", "classify.confidence",
                       F.col("audit.routed_to_review").alias("routed"))


@query("snk_audit_csv", """SELECT item_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, mpn, 'Maker "Q", ' || state AS manufacturer, CASE WHEN routed THEN item_id ELSE '' END AS brand, coalesce(code, '') AS unspsc,
 confidence::VARCHAR AS classification_confidence, coalesce(cache_hit::VARCHAR, '') AS cache_hit, adjudicated::VARCHAR AS adjudication_invoked, routed::VARCHAR AS routed_to_review FROM records""")
def _(t):
    path = scratch_path(t.spark, "audit-csv")
    src.write_csv(dl.audit_columns(nested(t)), path, quote_all=True)
    back = src._open_csv(t.spark, path).schema(", ".join(f"{c} string" for c in dl.AUDIT_COLUMNS)).csv(path)
    return back.na.fill("")


@query("trc_flatten", """SELECT event_id, item_id, code, confidence, 'Size=' || mpn || ':-|Color=' || state || ':' || CASE WHEN routed THEN 'ambiguous' ELSE 'supported' END AS attributes, CASE WHEN routed THEN 'brand' ELSE '' END AS flags FROM records""")
def _(t):
    df = nested(t)
    flat = dl.flatten_trace(df.withColumn("item_id", F.struct("event_id", "item_id")))
    shown = F.transform("attributes", lambda a: F.concat(a["label"], F.lit("="), a["value"], F.lit(":"), F.coalesce(a["entailment"], F.lit("-"))))
    return flat.select("item_id.event_id", "item_id.item_id", "code", "confidence", F.array_join(shown, "|").alias("attributes"), F.array_join("flags", "|").alias("flags"))
