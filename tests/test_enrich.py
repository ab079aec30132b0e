"""Two rows through the whole job: one that is delivered in full, one that is not."""

from attestry.enrich import Answers, References, enrich
from attestry.operators import entities as en
from attestry.operators import taxonomy as tax


def test_two_rows(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    catalog = make([(1, "PN-1", "Whirlpool stainless steel dishwasher 24 in wide with quiet motor and third rack", "Whirlpool", "-- N/A --", None, "Whirlpool Corp (7)"),
                    (2, "PN-2", "mystery thing", None, "No Unilog Brand", "unknown", "n/a")],
                   "row_no bigint, mfg_part_num string, part_desc string, e1_brand string, unilog_brand string, dib_brand string, part_manuf string")
    path = "Goods>Kitchen>Washers>Dishwasher"
    refs = References(
        brands=make([("whirlpool", "Whirlpool")], "key string, canonical_name string"),
        manufacturers=make([("whirlpool", "Whirlpool")], "key string, canonical_name string"),
        pairs=make([("whirlpool", "Whirlpool")], "brand_key string, manufacturer string"),
        taxonomy=make([("10000001", "Dishwasher", "F1", "Kitchen", "S1", "Goods", "C1", "Washers"), ("10000002", "Hammer", "F2", "Tools", "S1", "Goods", "C2", "Hand tools")],
                      "commodity_code string, commodity_name string, family_code string, family_name string, segment_code string, segment_name string, class_code string, class_name string"),
        classes=make([("C1", [1.0, 0.0]), ("C2", [0.0, 1.0])], "class_code string, vector array<double>"),
        labels=make([(path, "Material", (1, 1)), (path, "Width", (1, 2)), (path, "Color", (1, 3))], "classpath string, label string, seen struct<row_no:bigint,slot:int>"),
        allowed=make([(path, "Material", "Stainless Steel", None, 1)], "classpath string, label string, value string, uom string, seq bigint"),
        closed=make([(path, "Material")], "classpath string, label string"),
        product_names=make([(path, "Dishwasher")], "classpath string, product_name string"))
    given = Answers(
        vectors=make([(1, [1.0, 0.0]), (2, [0.1, 0.1])], "item_id bigint, vector array<double>"),
        candidates=make([(1, 0, "Material", "stainless steel", None, "stainless steel dishwasher", "description"), (1, 1, "Width", "24", "in", "24 in wide", "description"),
                         (1, 2, "Color", "red", None, "red", "description"), (1, 3, "Flavor", "motor", None, "motor", "description")],
                        "item_id bigint, pos int, label string, value string, uom string, source_excerpt string, source_type string"),
        verdicts=make([(1, 0, "Material", "supported", 0.95, "stated"), (1, 1, "Width", "supported", 0.9, "stated")],
                      "item_id bigint, pos int, label string, entailment string, confidence double, reasoning string"),
        decisions=make([], "item_id bigint, label string, selected_candidate_id string, needs_human_review boolean, reasoning string, rejected_candidate_ids array<string>"))
    out = enrich(catalog, refs, given)

    record = {r["item_id"]: r for r in out.record.collect()}
    assert (record[1]["brand"], record[1]["manufacturer"], record[1]["code"], record[1]["classpath"]) == ("Whirlpool", "Whirlpool", "10000001", path)
    assert (record[2]["brand"], record[2]["manufacturer"], record[2]["code"], record[2]["routed"]) == (None, None, None, True)
    assert record[1]["expected"] == 3 and record[1]["produced"] == 2

    assert {(r["item_id"], r["label"], r["value"], r["uom"]) for r in out.attributes.collect()} == {(1, "Material", "Stainless Steel", None), (1, "Width", "24", "in")}
    flags = {(r["item_id"], r["code"], r["field"]) for r in out.flags.collect()}
    assert {(1, "source_excerpt_unverified", "Color"), (1, "unexpected_attribute_rejected", "Flavor"), (2, "manufacturer_unresolved", "manufacturer"),
            (2, "classification_unresolved", "classpath")} <= flags

    wide = {r["item_id"]: r for r in out.delivery.collect()}
    slots = {wide[1][f"attribute_label_{i}"]: (wide[1][f"attribute_value_{i}"], wide[1][f"attribute_uom_{i}"]) for i in range(1, 4)}
    assert slots == {"Material": ("Stainless Steel", None), "Width": ("24", "in"), "Color": (None, None)}
    assert wide[1]["manufacturer_part_number"] == "PN-1" and wide[1]["unilog_brand"] == "-- N/A --"     # submitted cells stay as they came
    assert wide[2]["brand"] is None and wide[2]["classpath"] is None and wide[2]["part_desc"] == "mystery thing"

    filled = {(r["item_id"], r["field"]) for r in out.provenance.collect()}
    shown = {(i, c) for i in wide for c in wide[i].asDict() if c not in ("item_id", "product_name") and wide[i][c]}
    assert shown == {x for x in filled if x[1] != 'product_name'} and (2, "brand") not in filled


def test_alike_queries_are_searched_once(spark, monkeypatch):
    taxonomy = spark.createDataFrame([("10000001", "Dishwasher", "F1", "Kitchen", "S1", "Goods", "C1", "Washers"), ("10000002", "Hammer", "F2", "Tools", "S1", "Goods", "C2", "Hand tools")],
                                     "commodity_code string, commodity_name string, family_code string, family_name string, segment_code string, segment_name string, class_code string, class_name string")
    classes = spark.createDataFrame([("C1", [1.0, 0.0]), ("C2", [0.0, 1.0])], "class_code string, vector array<double>")
    rows = [(i, ["steel dishwasher", "claw hammer", None, ""][i % 4], None) for i in range(40)]
    rows += [(40, "steel dishwasher", [0.0, 1.0]), (41, "steel dishwasher", [1.0, 0.0]), (42, "claw hammer", [0.0, 1.0])]
    queries = spark.createDataFrame(rows, "query_id bigint, query string, vector array<double>")
    plain = lambda df: sorted(map(str, df.collect()))
    whole = tax.decide(tax.search(queries, taxonomy, classes), queries)
    search, seen = tax.search, []
    monkeypatch.setattr(tax, "search", lambda q, *rest: seen.append(q.count()) or search(q, *rest))
    out = tax.classify(queries, taxonomy, classes)
    assert plain(out.select(*whole.columns)) == plain(whole) and len(plain(out)) == 43 and seen == [7]


def test_rows_that_state_the_same_names_are_resolved_once(spark, monkeypatch):
    rows = [(i, "PN", ["Whirlpool", None, "Whirlpol"][i % 3], ["Bosch", None][i % 2], None, ["Bosch GmbH", None, "Unheard of"][i % 3]) for i in range(60)]
    cleaned = spark.createDataFrame(rows, "row_no bigint, mfg_part_num string, e1_brand string, unilog_brand string, dib_brand string, part_manuf string")
    names = spark.createDataFrame([("whirlpool", "Whirlpool"), ("bosch", "Bosch")], "key string, canonical_name string")
    pairs = spark.createDataFrame([("whirlpool", "Whirlpool Corp")], "brand_key string, manufacturer string")
    seen = []
    monkeypatch.setattr(en, "resolve_names", lambda ev, *rest, f=en.resolve_names: seen.append(ev.count()) or f(ev, *rest))
    out = {r["row_no"]: r for r in en.resolve_catalog(cleaned, names, names, pairs).collect()}
    assert len(out) == 60 and seen == [18]      # three fields of six distinct triples
    for i in range(60):
        brand = [("Whirlpool", False), (None, False), ("Whirlpool", False)][i % 3] if i % 2 else [(None, True), ("Bosch", False), (None, True)][i % 3]
        if i % 3 != 2:
            assert (out[i]["brand"], out[i]["brand_conflict"]) == brand, (i, out[i])
        assert out[i].asDict() | {"row_no": 0} == out[i % 6].asDict() | {"row_no": 0}
    assert out[0]["manufacturer"] == "Bosch" and out[3]["manufacturer"] == "Whirlpool Corp" and out[1]["manufacturer"] is None
