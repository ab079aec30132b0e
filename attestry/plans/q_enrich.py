"""Queries over the whole job on the driver tables."""

from pyspark.sql import functions as F

from attestry.enrich import Answers, References, enrich
from attestry.functions.vectors import l2_normalize
from attestry.operators import attributes as at
from attestry.operators import entities as en
from attestry.plans.adapters import VIEWS, spread
from attestry.plans.q_attributes import triples
from attestry.plans.q_taxonomy import class_vectors
from attestry.plans.registry import query
from attestry.session import cut_lineage

# what an extractor would have found in the descriptions: two stated values, one that is not stated, one label nobody asked for
VIEWS["catalog_candidates"] = """
SELECT p_partkey + 1 AS item_id, pos, label, value, uom, excerpt AS source_excerpt, 'description' AS source_type FROM (
  SELECT p_partkey, 0 AS pos, 'Color' AS label, substr(p_name, 1, 3) AS value, CAST(NULL AS STRING) AS uom, p_name AS excerpt FROM {part}
  UNION ALL SELECT p_partkey, 1, 'Size', CAST(p_size + 20 AS STRING), 'in', CAST(p_size + 20 AS STRING) || ' in' FROM {part}
  UNION ALL SELECT p_partkey, 2, 'Series', p_brand, CAST(NULL AS STRING), p_brand FROM {part}
  UNION ALL SELECT p_partkey, 3, 'Flavor', p_name, CAST(NULL AS STRING), p_name FROM {part}) x
"""
VIEWS["catalog_verdicts"] = """
SELECT item_id, pos, label, CASE WHEN item_id % 7 = 0 THEN 'ambiguous' ELSE 'supported' END AS entailment,
  CAST(CASE WHEN item_id % 5 = 0 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence, 'stated' AS reasoning FROM {catalog_candidates} WHERE item_id % 11 <> 0
"""


def references(t) -> References:
    counted = cut_lineage(en.count_spellings(en.cleaned_spellings(en.written_observations(t.catalog, t.truth), ["kind"])))
    of = lambda kind: en.canonical_entries(en.assign_leaders(counted.where(F.col("kind") == kind).drop("kind")))
    long = triples(t)
    vocabulary = at.value_vocabulary(long).withColumn("seq", F.col("seen.row_no") * 100 + F.col("seen.slot")).select("classpath", "label", "value", "uom", "seq")
    return References(of("brand"), of("manufacturer"), en.pairing(t.truth), t.taxonomy, class_vectors(t), at.expected_labels(long), cut_lineage(vocabulary),
                      t.spark.createDataFrame([], "classpath string, label string"), at.product_names(t.truth), lookups=t.lookup_cache)


def enriched(t):
    t = t.given(part=spread(t.part))      # millions of parts are one split of a file
    t = t.given(catalog=spread(t.hold(catalog=t.catalog.columns).catalog))     # read by the references, the job and its delivery
    vectors = t.embeddings.select((F.col("vec_id") + 1).alias("item_id"), l2_normalize(F.col("embedding")).alias("vector"))
    decisions = t.spark.createDataFrame([], "item_id bigint, label string, selected_candidate_id string, needs_human_review boolean, reasoning string, rejected_candidate_ids array<string>")
    return enrich(t.catalog, references(t), Answers(vectors, t.catalog_candidates, t.catalog_verdicts, decisions))


@query("pipeline_delivery")
def _(t):
    return enriched(t).delivery
