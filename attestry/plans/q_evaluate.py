"""Queries over truth evaluation, reports, sampling and record browsing."""

from pyspark.sql import functions as F

from attestry.operators import attributes as at
from attestry.operators import auditing as au
from attestry.operators import browse, evaluation as evl, sampling
from attestry.plans.adapters import VIEWS
from attestry.plans.q_attributes import triples
from attestry.plans.q_text import d_collapse, d_fold
from attestry.plans.q_units import d_unit
from attestry.plans.registry import FRAGMENTS, query

# pipeline output to compare with the truth rows
VIEWS["outcome"] = """
SELECT row_no, CASE row_no % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(manufacturer_name) ELSE manufacturer_name END AS manufacturer,
  CASE row_no % 3 WHEN 0 THEN 'Other' ELSE replace(brand_name, '®', '') END AS brand, mobile_desc, lower(invoice_desc) AS invoice_desc,
  CASE row_no % 5 WHEN 0 THEN NULL ELSE short_desc || ' ' END AS short_desc, retail_desc || '!' AS retail_desc, long_desc1, CAST(NULL AS STRING) AS marketing_description
FROM {truth}
"""
VIEWS["outcome_attrs"] = """
SELECT row_no, 'Size' AS label, attribute_value_6 AS value, CASE WHEN row_no % 2 = 0 THEN 'in' ELSE NULL END AS uom FROM {truth}
UNION ALL SELECT row_no, 'Series', upper(attribute_value_5), CAST(NULL AS STRING) FROM {truth} WHERE row_no % 3 <> 0
"""


def d_cmp(x, tm=False):
    x = f"translate({x}, '®™', '')" if tm else x
    return f"coalesce({d_collapse(d_fold(x))}, '')"


_D = ("mobile_desc", "invoice_desc", "short_desc", "long_desc1", "retail_desc", "marketing_description")
FRAGMENTS["wanted"] = f"SELECT row_no, label, value, {d_unit('uom')} AS uom FROM triples WHERE label <> '' AND value <> '' QUALIFY row_number() OVER (PARTITION BY row_no, label ORDER BY slot DESC) = 1"
FRAGMENTS["counts"] = f"""SELECT o.row_no, 'manufacturer' AS "group", ({d_cmp('o.manufacturer')} = {d_cmp('t.manufacturer_name')})::BIGINT AS correct, 1::BIGINT AS compared FROM outcome o JOIN truth t USING (row_no) WHERE trim(t.manufacturer_name) <> ''
UNION ALL SELECT o.row_no, 'brand', ({d_cmp('o.brand', True)} = {d_cmp('t.brand_name', True)})::BIGINT, 1 FROM outcome o JOIN truth t USING (row_no) WHERE trim(t.brand_name) <> ''
UNION ALL SELECT o.row_no, 'descriptions', {" + ".join(f"(trim(t.{c}) <> '' AND {d_cmp('o.' + c)} = {d_cmp('t.' + c)})::BIGINT" for c in _D)}, {" + ".join(f"(trim(t.{c}) <> '')::BIGINT" for c in _D)} FROM outcome o JOIN truth t USING (row_no)
UNION ALL SELECT o.row_no, 'attributes', count(*) FILTER (w.label IS NOT NULL AND coalesce({d_cmp('a.value')} = {d_cmp('w.value')} AND a.label IS NOT NULL, false) AND a.uom IS NOT DISTINCT FROM w.uom), count(w.label)
  FROM outcome o LEFT JOIN wanted w USING (row_no) LEFT JOIN outcome_attrs a ON a.row_no = w.row_no AND a.label = w.label GROUP BY 1"""
FRAGMENTS["acc"] = """SELECT row_no, "group", CASE WHEN compared = 0 THEN 0 ELSE round_even(100.0 * correct / compared, 2)::DOUBLE END AS percent FROM counts
UNION ALL SELECT row_no, 'overall', round_even(100.0 * sum(correct) / sum(compared), 2)::DOUBLE FROM counts GROUP BY 1 UNION ALL SELECT row_no, 'classpath', NULL FROM outcome"""


def counts(t):
    return au.truth_counts(t.outcome, t.truth, t.outcome_attrs, at.truth_attributes(triples(t)))


@query("join_truth", 'SELECT row_no, "group", correct, compared FROM counts')
def _(t):
    return counts(t)


@query("agg_accuracy_row", 'SELECT row_no, "group", percent FROM acc')
def _(t):
    return au.accuracy(counts(t))


@query("agg_accuracy_macro", 'SELECT "group", round(avg(percent), 2) AS percent FROM acc GROUP BY 1')
def _(t):
    return au.macro_accuracy(au.accuracy(counts(t)))


@query("aud_truth_eval", """SELECT row_no, 'Ground truth leaves UNSPSC blank; excluded from accuracy denominator.' AS gap FROM truth WHERE trim(unspsc) = ''
UNION ALL SELECT row_no, 'Ground truth leaves Country Of Origin blank; excluded from accuracy denominator.' FROM truth WHERE trim(country_of_origin) = ''
UNION ALL SELECT row_no, 'Classpath accuracy is not directly comparable; excluded from accuracy denominator.' FROM truth WHERE trim(classpath) <> ''
UNION ALL SELECT row_no, upper(left("group", 1)) || substr("group", 2) || ' differs from the populated ground-truth value.' FROM counts WHERE "group" IN ('manufacturer', 'brand') AND correct = 0""")
def _(t):
    return au.gap_rows(t.truth, counts(t))


VIEWS["audit_rows"] = """
SELECT event_id, vocab_total, CASE WHEN vocab_total IS NULL THEN NULL ELSE CAST((event_id % (vocab_total + 1)) AS INT) END AS vocab_ok, produced, expected, desc_ok, desc_total, routed FROM {records}
"""


@query("agg_eval", """SELECT count(*) AS evaluated_rows, round(sum((round_even(100.0 * vocab_ok / nullif(vocab_total, 0), 2) * vocab_total)::DECIMAL(20,4))::DOUBLE / sum(vocab_total), 2) AS vocabulary_percent, sum(vocab_total)::BIGINT AS vocab_total,
 round(100.0 * sum(produced) / sum(expected), 2)::DOUBLE AS attribute_percent, round(100.0 * sum(desc_ok) / sum(desc_total), 2)::DOUBLE AS character_percent, round(100.0 * count(*) FILTER (routed) / count(*), 2)::DOUBLE AS routed_percent FROM audit_rows""")
def _(t):
    return evl.evaluation(t.audit_rows)


_SUM = """count(*) AS attempted, count(*) FILTER (state <> 'failed') AS completed, count(DISTINCT code) FILTER (state <> 'failed') AS distinct_codes, round(100.0 * count(code) FILTER (state <> 'failed') / count(*) FILTER (state <> 'failed'), 2)::DOUBLE AS classified_percent,
 round(avg(confidence) FILTER (state <> 'failed'), 4) AS mean_confidence_all, round(avg(confidence) FILTER (state <> 'failed' AND code IS NOT NULL), 4) AS mean_confidence_resolved, round(100.0 * count(*) FILTER (state <> 'failed' AND produced > 0) / count(*) FILTER (state <> 'failed'), 2)::DOUBLE AS with_attributes_percent,
 round(100.0 * sum(produced) FILTER (state <> 'failed') / sum(expected) FILTER (state <> 'failed'), 2)::DOUBLE AS yield_percent, round(100.0 * count(*) FILTER (state <> 'failed' AND routed) / count(*) FILTER (state <> 'failed'), 2)::DOUBLE AS review_percent"""


@query("agg_summary", f"SELECT {_SUM} FROM records")
def _(t):
    return evl.summary(t.records)


@query("agg_category", """SELECT string_split(coalesce(classpath, 'Unresolved'), '>')[-1] AS category, count(*) AS rows, count(code) AS classified, count(*) FILTER (produced > 0) AS with_attributes,
 round(avg(confidence), 3) AS mean_confidence, count(*) FILTER (routed) AS reviewed FROM records WHERE state <> 'failed' GROUP BY 1""")
def _(t):
    return evl.by_category(t.records)


VIEWS["opinions"] = """
SELECT l.doc_id AS doc_id, CASE WHEN l.toxic = 1 THEN 'not_supported' WHEN l.quality = 1 THEN 'supported' ELSE 'partially_supported' END AS entailment,
  CAST(d.n_chars % 100 AS DOUBLE) / 100 AS confidence, l.toxic = 0 AS retained, (d.n_chars + l.quality) % 3 <> 0 AS plausible
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
"""


@query("agg_tiers", """WITH o AS (SELECT *, CASE WHEN confidence >= 0.95 THEN 'high' WHEN confidence >= 0.80 THEN 'medium' ELSE 'low' END AS tier FROM opinions)
SELECT entailment, tier, count(*) AS observations, count(*) FILTER (retained) AS retained, round(100.0 * count(*) FILTER (retained) / count(*), 2)::DOUBLE AS retained_percent,
 round(100.0 * count(*) FILTER (plausible) / count(*), 2)::DOUBLE AS plausible_percent FROM o GROUP BY GROUPING SETS ((entailment), (tier))""")
def _(t):
    return evl.tiers(t.opinions)


@query("agg_ops", """SELECT count(*) AS processed, count(*) FILTER (lookup_attempted) AS lookups, round(100.0 * count(*) FILTER (lookup_attempted AND cache_hit) / count(*) FILTER (lookup_attempted), 1)::DOUBLE AS cache_hit_percent,
 round(100.0 * count(*) FILTER (adjudicated) / count(*), 1)::DOUBLE AS conflict_percent, count(*) FILTER (NOT adjudicated) AS skipped FROM records""")
def _(t):
    return evl.operations(t.records)


_JOB = """SELECT batch_no, count(*) AS total_rows, count(*) FILTER (state = 'completed') AS completed_rows, count(*) FILTER (state = 'failed') AS failed_rows,
 CASE WHEN count(*) FILTER (state IN ('completed', 'failed')) = 0 THEN 'queued' WHEN count(*) FILTER (state IN ('completed', 'failed')) < count(*) THEN 'running' WHEN count(*) FILTER (state = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status
FROM records GROUP BY 1"""


@query("agg_job", _JOB)
def _(t):
    return evl.job_status(t.records, "batch_no")


@query("agg_vocab_state", "SELECT state, count(*) AS n FROM terms GROUP BY state")
def _(t):
    return t.terms.groupBy("state").agg(F.count("*").alias("n"))


@query("win_latest100", "SELECT item_id, event_id, state FROM (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1) x ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t):
    return evl.latest_records(t.records).select("item_id", "event_id", "state")


@query("top_diverse")
def _(t):
    items = t.documents.select(F.col("doc_id").alias("item_id"), "text", F.col("source").alias("maker"))
    return sampling.diverse_sample(items, 30)


@query("sch_records", "SELECT event_id, mpn, code FROM records WHERE (contains(code, '12') OR contains(lower(mpn), '12') OR contains(lower(item_id), '12') OR contains(lower(classpath), '12') OR contains(lower(state), '12')) AND starts_with(code, '4018') AND state = 'completed'")
def _(t):
    return browse.search_records(t.records, "12", "4018", "completed").select("event_id", "mpn", "code")


def terms_with_synonyms(t):
    syn = t.synonyms.groupBy("canonical").agg(F.collect_list("synonym").alias("synonyms"))
    return t.terms.join(syn, "canonical", "left")


@query("sch_vocab", "SELECT canonical, state FROM terms t WHERE state = 'MATCHED' AND (contains(lower(canonical), 'x1') OR contains(lower(category), 'x1') OR EXISTS (SELECT 1 FROM synonyms s WHERE s.canonical = t.canonical AND contains(lower(s.synonym), 'x1')))")
def _(t):
    return browse.search_terms(terms_with_synonyms(t), state="MATCHED", text="X1").select("canonical", "state")


@query("voc_promote", "SELECT canonical, seq, category, CASE WHEN seq % 3 = 0 THEN 'MATCHED' ELSE state END AS state FROM terms")
def _(t):
    approvals = t.terms.where(F.col("seq") % 3 == 0).select("canonical")
    return browse.promote(t.terms, approvals)
