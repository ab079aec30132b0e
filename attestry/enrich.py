"""The whole job: cleaned, resolved, classified, extracted, normalized, verified, settled, described, audited, delivered.

Each step reads what the step before it gave; the tables that several later
steps read are written once.  Nothing here looks at a row by itself: rows enter
as the catalog, answers of other systems (candidates, verdicts, decisions,
pages) as tables keyed by item.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.operators import adjudication as adj
from attestry.operators import attributes as at
from attestry.operators import auditing as au
from attestry.operators import cleaning, delivery
from attestry.operators import description as ds
from attestry.operators import entities as en
from attestry.operators import evidence as ev
from attestry.operators import taxonomy as tax
from attestry.operators import verification as ver
from attestry.params import DEFAULTS, Params
from attestry.session import cut_lineage


@dataclass
class References:
    brands: DataFrame           # key, canonical_name
    manufacturers: DataFrame    # key, canonical_name
    pairs: DataFrame            # brand_key, manufacturer
    taxonomy: DataFrame
    classes: DataFrame          # class_code, vector
    labels: DataFrame           # classpath, label, seen: expected labels of known paths
    allowed: DataFrame          # classpath, label, value, uom, seq
    closed: DataFrame           # classpath, label
    product_names: DataFrame    # classpath, product_name
    limits: dict[str, int] = field(default_factory=lambda: dict(ds.DEFAULT_LIMITS))
    lookups: DataFrame | None = None    # part_key, manufacturer, confidence


@dataclass
class Answers:
    vectors: DataFrame          # item_id, vector of the classification query
    candidates: DataFrame       # item_id, pos, label, value, uom, source_excerpt, source_type
    verdicts: DataFrame         # item_id, pos, label, entailment, confidence, reasoning
    decisions: DataFrame        # item_id, label, selected_candidate_id, needs_human_review, reasoning, rejected_candidate_ids
    pages: DataFrame | None = None      # item_id, url, text
    domains: DataFrame | None = None    # item_id, domain


@dataclass
class Enriched:
    record: DataFrame           # one row per item: names, class, descriptions, percentages, routed
    flags: DataFrame            # item_id, code, field
    attributes: DataFrame       # item_id, label, value, uom, source_type: settled values
    status: DataFrame           # item_id, field, okay
    delivery: DataFrame         # source columns, gated fields, descriptions, attribute slots
    provenance: DataFrame       # item_id, field, stage, confidence, source_type


def _named_paths(decided: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classpath, path): each decided class path and the known path nearest to it; (classpath, label, slot): its labels."""
    paths = decided.select("classpath").where("classpath is not null").distinct()
    near = cut_lineage(tax.nearest_path(paths, labels.select(F.col("classpath").alias("path"))))
    order = Window.partitionBy("classpath").orderBy("a", "b")     # as many rows as a path has labels
    expected = at.labels_or_generic(paths, near, labels).withColumn("slot", F.row_number().over(order)).select("classpath", "label", "slot")
    return near.select("classpath", "path"), cut_lineage(expected)


def enrich(catalog: DataFrame, refs: References, given: Answers, p: Params = DEFAULTS) -> Enriched:
    """`catalog`: row_no and the six distributor columns."""
    cleaned = cut_lineage(cleaning.clean_catalog(catalog))
    resolved = cut_lineage(en.resolve_catalog(cleaned, refs.brands, refs.manufacturers, refs.pairs, refs.lookups, p)).withColumnRenamed("row_no", "item_id")
    flags = en.resolution_flags(resolved, p, "item_id").select("item_id", "code", "field")

    asked = resolved.select(F.col("item_id").alias("query_id"), tx.classification_query(F.col("part_desc"), F.col("mfg_part_num")).alias("query"))
    queries = cut_lineage(asked.join(given.vectors.select(F.col("item_id").alias("query_id"), "vector"), "query_id", "left"))
    decided = cut_lineage(tax.classify(queries, refs.taxonomy, refs.classes, p)).withColumnRenamed("query_id", "item_id")
    flags = flags.unionByName(decided.select("item_id", F.explode("flags").alias("code"), F.lit("classpath").alias("field")))
    near, expected = _named_paths(decided, refs.labels)

    items = resolved.join(decided.select("item_id", "classpath"), "item_id").withColumn("mpn", F.col("mfg_part_num"))
    items = items.join(given.domains, "item_id", "left") if given.domains is not None else items.withColumn("domain", F.lit(None).cast("string"))
    pages = given.pages if given.pages is not None else items.sparkSession.createDataFrame([], "item_id bigint, url string, text string")
    marked = ev.official_sources(items, pages)
    flags = flags.unionByName(ev.source_flags(items, marked).select("item_id", "code", F.lit("sources").alias("field")))
    gated = cut_lineage(ev.gate(given.candidates, items, expected, ev.source_blocks(items, marked)))
    flags = flags.unionByName(gated.where("reason is not null").select("item_id", F.col("reason").alias("code"), F.col("label").alias("field")))
    extracted = cut_lineage(gated.where("reason is null").select("item_id", "label", F.lit(0).alias("idx"), "value", "uom", "source_type"))

    normalized = cut_lineage(at.normalize_stage(extracted, items.select("item_id", "classpath"), refs.allowed, refs.closed, p.attribute_match, p.category_cutoff))
    flags = flags.unionByName(normalized.where("reason is not null").select("item_id", F.col("reason").alias("code"), F.col("label").alias("field")))

    failed = items.select("item_id").limit(0)
    checked = cut_lineage(ver.merge_verdicts(extracted, given.verdicts, ver.compliance(extracted, normalized), failed))
    flags = flags.unionByName(checked.where("flag is not null").select("item_id", F.col("flag").alias("code"), F.col("label").alias("field")))

    sourced = normalized.join(extracted.select("item_id", "label", "idx", "source_type"), ["item_id", "label", "idx"])
    options = cut_lineage(adj.candidates(extracted, sourced))
    state = cut_lineage(adj.conflicts(options, checked))
    settled = cut_lineage(adj.settle(options, state, given.decisions))
    final = cut_lineage(adj.final_attributes(options, state, settled).select("item_id", "label", "value", "uom", "source_type"))
    flags = flags.unionByName(settled.where("needs_review").select("item_id", F.lit("adjudication_needs_review").alias("code"), F.col("label").alias("field")))

    named = items.join(near, "classpath", "left").join(refs.product_names.select(F.col("classpath").alias("path"), "product_name"), "path", "left")
    named = named.select("item_id", F.coalesce("product_name", tx.leaf(F.col("classpath"))).alias("product_name"), "brand", "manufacturer", "mpn")
    described = cut_lineage(ds.build(ds.with_attribute_map(named, final), refs.limits, p.mobile_target))
    flags = flags.unionByName(described.select("item_id", F.explode("desc_flags").alias("f")).select("item_id", "f.code", "f.field"))

    base = resolved.join(decided.select("item_id", "code", "classpath", F.col("confidence").alias("class_confidence")), "item_id")
    labelled = cut_lineage(base.select("item_id", "classpath").join(expected, "classpath").select("item_id", "label", "slot"))
    fields = ds.field_rows(described)
    status = cut_lineage(au.status_rows(base, labelled.select("item_id", "label"), final, checked, fields, p))
    routed = au.route(status, settled.select("item_id", F.col("needs_review")))
    figures = au.percentages(status, labelled.select("item_id", "label"), extracted, normalized, checked, fields)
    texts = ["MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC"]
    record = base.join(described.select("item_id", "product_name", *texts), "item_id").join(figures, "item_id").join(routed, "item_id")

    slots = cut_lineage(delivery.slot_rows(labelled, final, status, checked))
    okay = status.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "okay"))).alias("status"))     # one item's fields
    gates = {"manufacturer": "manufacturer", "brand": "brand", "classpath": "classpath", "code": "classpath",
             **{f: f"description:{f}" for f in texts}, "product_name": None}
    gatedf = delivery.gated_columns(record.join(okay, "item_id"), F.col("status"), gates)
    source = delivery.source_columns(catalog.withColumnRenamed("row_no", "item_id"))
    wide = source.join(gatedf, "item_id").join(delivery.wide_slots(slots), "item_id", "left")
    provenance = _provenance(source, base, slots, status, gates)
    return Enriched(record, flags.where(F.col("code").isNotNull()), final, status, wide, provenance)


def _provenance(source: DataFrame, base: DataFrame, slots: DataFrame, status: DataFrame, gates: dict) -> DataFrame:
    """Where each filled field comes from, and how sure it is."""
    ok = status.where("okay").select("item_id", F.col("field").alias("gate"))
    stage = {"manufacturer": ("brand_resolution", "manufacturer_confidence"), "brand": ("brand_resolution", "brand_confidence"),
             "classpath": ("classify", "class_confidence"), "code": ("classify", "class_confidence")}
    made = {f: stage.get(f, ("description", None)) for f in gates if gates[f]}
    rows = base.select("item_id", F.inline(F.array(*[F.struct(
        F.lit(f).alias("field"), F.lit(gates[f]).alias("gate"), F.lit(s).alias("stage"),
        (F.col(c).cast("double") if c else F.lit(None).cast("double")).alias("confidence")) for f, (s, c) in made.items()])))
    named = rows.join(ok, ["item_id", "gate"]).select("item_id", "field", "stage", "confidence", F.lit(None).cast("string").alias("source_type"))
    names = [c for c in source.columns if c != "item_id"]
    sent = source.select("item_id", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names]))).alias("field"),
                         F.lit("input").alias("stage"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source_type"))
    return sent.unionByName(named).unionByName(delivery.provenance_rows(slots, base.select("item_id", "class_confidence")).select(
        "item_id", "field", "stage", "confidence", "source_type"))
