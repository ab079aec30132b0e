"""Wide delivery rows with per-field provenance, and nested record sinks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.auditing import verdict_good
from attestry.params import DEFAULTS, Params

SOURCE_FIELDS = ("mfg_part_num", "part_desc", "e1_brand", "unilog_brand", "dib_brand", "part_manuf")


def filled(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def source_columns(raw: DataFrame, key: str = "item_id") -> DataFrame:
    """Submitted columns unchanged (placeholders stay), plus the part number copy."""
    return raw.select(key, *[filled(F.col(c)).alias(c) for c in SOURCE_FIELDS],
                      filled(F.col("mfg_part_num")).alias("manufacturer_part_number"))


def gated_columns(rows: DataFrame, status: Column, gates: dict[str, str | None]) -> DataFrame:
    """Values appear only where their status is true; a gate of None always passes."""
    keep = lambda c, g: filled(F.col(c)) if g is None else F.when(F.try_element_at(status, F.lit(g)), filled(F.col(c)))
    return rows.select("item_id", *[keep(c, g).alias(c) for c, g in gates.items()])


def slot_rows(expected: DataFrame, final: DataFrame, status: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Expected labels with slot number; value and unit only when the status allows."""
    ok = status.where(F.col("field").startswith("attribute:") & F.col("okay")).select(
        "item_id", F.substring("field", 11, 1 << 20).alias("label"), F.lit(True).alias("__ok"))
    v = verdicts.select("item_id", "label", F.col("confidence").alias("__c"))
    rows = (expected.join(final.select("item_id", "label", "value", "uom", "source_type"), ["item_id", "label"], "left")
            .join(ok, ["item_id", "label"], "left").join(v, ["item_id", "label"], "left"))
    show = F.col("__ok") & F.col("value").isNotNull()
    return rows.select("item_id", "slot", "label", *[F.when(show, F.col(c)).alias(c) for c in ("value", "uom", "source_type")],
                       F.when(show, F.col("__c")).alias("confidence"))


def judged_slots(expected: DataFrame, final: DataFrame, verdicts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The rows of `slot_rows` where a label of an item has at most one value and one verdict: the status is judged in the row."""
    v = verdicts.select("item_id", "label", F.col("confidence").alias("__c"), verdict_good(p).alias("__ok"))
    rows = expected.join(final.select("item_id", "label", "value", "uom", "source_type"), ["item_id", "label"], "left").join(v, ["item_id", "label"], "left")
    show = F.col("__ok") & F.col("value").isNotNull()
    return rows.select("item_id", "slot", "label", *[F.when(show, F.col(c)).alias(c) for c in ("value", "uom", "source_type")],
                       F.when(show, F.col("__c")).alias("confidence"))


def slot_maps(slots: DataFrame, n: int = 50) -> DataFrame:
    """(item_id, slots): MAP<slot, STRUCT(label, value, uom)> of an item; a label past the last slot stops the job."""
    past = F.raise_error(F.concat(F.lit(f"more than {n} labels: item "), F.col("item_id").cast("string"))).cast("int")
    slots = slots.withColumn("slot", F.when(F.col("slot").between(1, n), F.col("slot")).otherwise(past))
    return slots.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("label", "value", "uom")))).alias("slots"))


def slot_cells(n: int = 50) -> list[Column]:
    """Label/value/unit columns for every slot of the map `slots`; gaps stay."""
    cell = lambda i, f: filled(F.try_element_at("slots", F.lit(i))[f])
    return [cell(i, f).alias(f"attribute_{f}_{i}") for i in range(1, n + 1) for f in ("label", "value", "uom")]


def wide_slots(slots: DataFrame, n: int = 50) -> DataFrame:
    """One row per item with its `slot_cells`."""
    return slot_maps(slots, n).select("item_id", *slot_cells(n))


def provenance_rows(slots: DataFrame, class_confidence: DataFrame) -> DataFrame:
    """(item_id, field, stage, confidence, source_type) for every filled slot field."""
    s = slots.join(class_confidence, "item_id", "left")
    entry = lambda f, c, stage, conf, src: F.when(F.length(F.col(c)) > 0, F.struct(
        F.concat(F.lit(f), F.col("slot").cast("string")).alias("field"), F.lit(stage).alias("stage"), conf.alias("confidence"), src.alias("source_type")))
    none = F.lit(None).cast("string")
    return s.select("item_id", F.inline(F.array_compact(F.array(
        entry("attribute_label_", "label", "classify", F.col("class_confidence"), none),
        entry("attribute_value_", "value", "adjudicate", F.col("confidence"), F.col("source_type")),
        entry("attribute_uom_", "uom", "adjudicate", F.col("confidence"), F.col("source_type"))))))


def provenance_map(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "field", F.struct("stage", "confidence", "source_type")))).alias("provenance"))


AUDIT_COLUMNS = {"item_id": "item_id", "created_at": "created_at", "mpn": "input.mfg_part_num",
                 "manufacturer": "brand_resolution.manufacturer.canonical_name", "brand": "brand_resolution.brand.canonical_name",
                 "unspsc": "classify.code", "classification_confidence": "classify.confidence", "cache_hit": "brand_resolution.cache_hit",
                 "adjudication_invoked": "adjudicate.invoked", "routed_to_review": "audit.routed_to_review"}


def audit_columns(records: DataFrame) -> DataFrame:
    """Ten text columns flattened out of nested records; NULL becomes ''."""
    return records.select(*[F.coalesce(F.col(path).cast("string"), F.lit("")).alias(name) for name, path in AUDIT_COLUMNS.items()])


def flatten_trace(records: DataFrame) -> DataFrame:
    """Compact evaluation row of a nested record; verdicts are attached by label."""
    by_label = F.map_from_entries(F.transform("verify.results", lambda r: F.struct(r["label"], r)))
    attrs = F.transform("extract.attributes", lambda a: F.struct(
        a["label"].alias("label"), a["value"].alias("value"),
        F.try_element_at(by_label, a["label"])["entailment"].alias("entailment"),
        F.try_element_at(by_label, a["label"])["confidence"].alias("verification_confidence")))
    return records.select("item_id", F.col("classify.code").alias("code"), F.col("classify.confidence").alias("confidence"),
                          attrs.alias("attributes"), F.transform("audit.flags", lambda f: f["field"]).alias("flags"))
