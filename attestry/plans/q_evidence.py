"""Queries over source blocks, excerpts and the extraction gates."""

from pyspark.sql import functions as F

from attestry.operators import evidence as ev
from attestry.plans.adapters import VIEWS
from attestry.plans.q_text import d_collapse, d_domain, d_fold
from attestry.plans.registry import FRAGMENTS, query

VIEWS["expected"] = """
SELECT DISTINCT i.classpath AS classpath, c.label AS label FROM {candidates} c JOIN {items} i ON i.item_id = c.item_id
WHERE c.label <> 'Warranty' AND NOT (c.label = 'Grade' AND i.classpath LIKE '%PROMO%')
"""
FRAGMENTS["gated"] = rf"""SELECT *, coalesce((length(part_desc) < 80 OR len(string_split({d_collapse('part_desc')}, ' ')) < 8) AND domain IS NOT NULL AND manufacturer_confidence >= 0.86, false) AS use_site FROM items"""
FRAGMENTS["marked"] = f"""SELECT e.*, {d_domain('e.url')} = g.domain OR ends_with({d_domain('e.url')}, '.' || g.domain) AS official FROM evidence e JOIN gated g ON g.item_id = e.item_id AND g.use_site"""
FRAGMENTS["blocks"] = """SELECT item_id, 'description' AS source_type, part_desc AS text FROM items UNION ALL SELECT item_id, 'manufacturer_site', text FROM marked WHERE official"""
FRAGMENTS["backed"] = f"""SELECT c.* FROM candidates c WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.item_id = c.item_id AND b.source_type = c.source_type AND contains({d_fold('b.text')}, {d_fold('c.source_excerpt')}))"""


def marked(t):
    return ev.official_sources(t["items"], t.evidence)


@query("ext_gate_retrieval", "SELECT item_id, use_site FROM gated")
def _(t):
    return ev.retrieval_gate(t["items"]).select("item_id", "use_site")


@query("ext_filter_sources", """WITH s AS (SELECT g.item_id, count(*) FILTER (official) AS kept, count(*) FILTER (NOT official) AS refused FROM gated g LEFT JOIN marked m USING (item_id) WHERE g.use_site GROUP BY 1)
SELECT item_id, 'non_official_sources_rejected' AS code, kept FROM s WHERE refused > 0 UNION ALL SELECT item_id, 'manufacturer_retrieval_no_results', kept FROM s WHERE kept = 0""")
def _(t):
    return ev.source_flags(t["items"], marked(t))


@query("set_union_sources", "SELECT item_id, source_type, text FROM blocks")
def _(t):
    return ev.source_blocks(t["items"], marked(t))


@query("join_excerpt", "SELECT item_id, pos, label, source_type FROM backed")
def _(t):
    return ev.supported_excerpts(t.candidates, ev.source_blocks(t["items"], marked(t))).select("item_id", "pos", "label", "source_type")


FRAGMENTS["gate1"] = rf"""SELECT c.item_id, c.pos, c.label, x.label IS NOT NULL AS exp_ok, b.pos IS NOT NULL AS src_ok,
 contains({d_collapse(d_fold('c.source_excerpt'))}, {d_collapse(d_fold('c.value'))}) AS val_ok,
 CASE WHEN c.label IN ('Series', 'Model') AND lower(trim(c.value)) = lower(i.mpn) THEN
   regexp_matches(c.source_excerpt, '(?i)\b' || lower(c.label) || '\b\s*[:#-]?\s*' || trim(c.value) || '\b') OR regexp_matches(c.source_excerpt, '(?i)\b' || trim(c.value) || '\b\s*[-,]?\s*\b' || lower(c.label) || '\b') ELSE true END AS idn_ok
FROM candidates c JOIN items i USING (item_id) LEFT JOIN expected x ON x.classpath = i.classpath AND x.label = c.label LEFT JOIN (SELECT item_id, pos FROM backed) b ON b.item_id = c.item_id AND b.pos = c.pos"""
FRAGMENTS["gate2"] = """SELECT *, min(CASE WHEN exp_ok AND src_ok AND val_ok AND idn_ok THEN pos END) OVER (PARTITION BY item_id, label) AS first_pos FROM gate1"""
FRAGMENTS["gate3"] = """SELECT item_id, pos, label, CASE WHEN NOT exp_ok OR pos > first_pos THEN 'unexpected_attribute_rejected' WHEN NOT src_ok THEN 'source_excerpt_unverified'
  WHEN NOT val_ok THEN 'ungrounded_value_rejected' WHEN NOT idn_ok THEN 'product_identity_leakage_rejected' END AS reason FROM gate2"""


def gated(t):
    return ev.gate(t.candidates, t["items"], t.expected, ev.source_blocks(t["items"], marked(t)))


@query("ext_gates", "SELECT item_id, pos, label, reason FROM gate3")
def _(t):
    return gated(t).select("item_id", "pos", "label", "reason")


@query("win_dedupe_label", """SELECT item_id, label, value, source_type, pos FROM candidates WHERE source_excerpt <> 'quoted from nowhere'
 QUALIFY row_number() OVER (PARTITION BY item_id, label ORDER BY pos) = 1""")
def _(t):
    f = ev.first_per_label(t.candidates, F.col("source_excerpt") != "quoted from nowhere", ["item_id", "label"], "pos")
    return f.select("item_id", "label", "value", "source_type", "pos")


@query("ext_fail", "SELECT o_orderkey AS item_id, CASE WHEN f.item_id IS NOT NULL THEN 'extraction_failed' END AS code FROM orders LEFT JOIN failed_items f ON f.item_id = o_orderkey")
def _(t):
    return ev.failure_flags(t.orders.select(F.col("o_orderkey").alias("item_id")), t.failed_items)


VIEWS["phrases"] = """
SELECT DISTINCT 'Series' AS label, p_brand AS value FROM {part} UNION SELECT DISTINCT 'Grade', p_type || ' grade' FROM {part} UNION SELECT DISTINCT 'Color', substr(p_name, 1, 3) FROM {part}
"""


@query("ext_candidates", "SELECT item_id, label, value, value AS source_excerpt, 'description' AS source_type FROM items JOIN phrases ON contains(lower(part_desc), lower(value))")
def _(t):
    return ev.phrase_candidates(t["items"], t.phrases)


@query("ext_candidates_map", r"SELECT item_id, 'Size' AS label, regexp_extract(part_desc, 'Size (\d+ in)', 1) AS value FROM items WHERE part_desc LIKE '%Size%'")
def _(t):
    import re

    def sizes(batches):
        for b in batches:
            found = b["part_desc"].map(lambda d: re.search(r"Size (\d+ in)", d))
            hit = b[found.notna()]
            yield hit.assign(label="Size", value=[m.group(1) for m in found[found.notna()]])[["item_id", "label", "value"]]

    return ev.run_extractor(t["items"].select("item_id", "part_desc"), sizes, "item_id bigint, label string, value string")
