"""Queries over verdicts, conflicts and decisions."""

from pyspark.sql import functions as F

from attestry.operators import adjudication as adj
from attestry.operators import verification as ver
from attestry.plans.adapters import VIEWS
from attestry.plans.q_text import d_cmp_key
from attestry.plans.q_units import d_unit, split_views
from attestry.plans.registry import FRAGMENTS, query
from attestry.session import stored

FRAGMENTS["comply"] = f"""SELECT e.item_id, e.label, e.idx, n.value IS NOT NULL AS vocabulary_compliant,
 s.valid AND (e.uom IS NULL OR {d_unit('e.uom')} IS NOT NULL) AND (n.uom IS NULL OR s.uom IS NOT DISTINCT FROM n.uom) AS uom_compliant
FROM extracted e JOIN ex_split s ON s.item_id = e.item_id AND s.label = e.label AND s.idx = e.idx
LEFT JOIN normalized n ON n.item_id = e.item_id AND n.label = e.label AND n.idx = e.idx"""
FRAGMENTS["judged"] = """SELECT v.*, k.label IS NOT NULL AND row_number() OVER (PARTITION BY v.item_id, v.label ORDER BY v.pos) = 1 AS accepted
FROM verdicts v LEFT JOIN (SELECT DISTINCT item_id, label FROM extracted) k USING (item_id, label)"""
FRAGMENTS["merged"] = """SELECT e.item_id, e.label, e.idx, e.value, CASE WHEN f.item_id IS NULL AND j.label IS NOT NULL THEN j.entailment ELSE 'ambiguous' END AS entailment,
 CASE WHEN f.item_id IS NULL AND j.label IS NOT NULL THEN j.confidence ELSE 0 END AS confidence,
 (f.item_id IS NULL AND j.label IS NOT NULL) AND c.vocabulary_compliant AS vocabulary_compliant, (f.item_id IS NULL AND j.label IS NOT NULL) AND c.uom_compliant AS uom_compliant,
 CASE WHEN f.item_id IS NOT NULL THEN 'verification_failed' WHEN j.label IS NULL THEN 'verification_incomplete' END AS flag
FROM extracted e LEFT JOIN (SELECT * FROM judged WHERE accepted) j ON j.item_id = e.item_id AND j.label = e.label LEFT JOIN failed_items f ON f.item_id = e.item_id
JOIN comply c ON c.item_id = e.item_id AND c.label = e.label AND c.idx = e.idx"""


@query("ver_compliance", "SELECT * FROM comply")
def _(t):
    return ver.compliance(t.extracted, t.normalized)


@query("join_verdict", "SELECT item_id, label, pos, accepted FROM judged")
def _(t):
    return ver.judge_verdicts(t.extracted, t.verdicts).select("item_id", "label", "pos", "accepted")


def merged(t):
    return ver.merge_verdicts(t.extracted, t.verdicts, ver.compliance(t.extracted, t.normalized), t.failed_items)


@query("ver_merge", "SELECT * FROM merged")
def _(t):
    return merged(t).drop("reasoning")


@query("join_norm_pair", "SELECT e.item_id, e.label, e.idx, e.value, n.value AS norm_value, n.uom AS norm_uom FROM extracted e LEFT JOIN normalized n USING (item_id, label, idx)")
def _(t):
    return adj.pair_by_position(t.extracted, t.normalized).select("item_id", "label", "idx", "value", "norm_value", "norm_uom")


VIEWS["cands"] = """
SELECT item_id, label, 'extracted:' || CAST(idx AS STRING) AS candidate_id, 'extracted' AS kind, idx AS lineage, value, uom, source_type,
  CASE source_type WHEN 'manufacturer_site' THEN 2 WHEN 'description' THEN 1 ELSE 0 END AS priority FROM {extracted}
UNION ALL SELECT item_id, label, 'normalized:' || CAST(idx AS STRING), 'normalized', idx, value, uom, source_type,
  CASE source_type WHEN 'manufacturer_site' THEN 2 WHEN 'description' THEN 1 ELSE 0 END FROM {normalized} WHERE value IS NOT NULL
"""


@query("adj_candidates", "SELECT * FROM cands")
def _(t):
    return adj.candidates(t.extracted, t.normalized)


split_views("cands", "item_id, candidate_id, kind, lineage, priority", tag="cd")
FRAGMENTS["keyed"] = f"""SELECT item_id, label, kind, lineage, priority, CASE WHEN valid THEN {d_cmp_key('value')} ELSE raw_value END || '~' || coalesce(CASE WHEN valid THEN uom ELSE raw_uom END, '-') AS sk FROM cd_norm"""
FRAGMENTS["first_verdict"] = "SELECT item_id, label, arg_min(entailment, idx) AS entailment FROM merged GROUP BY 1, 2"
FRAGMENTS["lin"] = "SELECT item_id, label, lineage, count(DISTINCT sk) AS n FROM keyed GROUP BY 1, 2, 3"
FRAGMENTS["state"] = """SELECT a.item_id, a.label, entailment, coalesce(entailment IN ('not_supported', 'ambiguous'), true) OR a.n_ext > 1 OR EXISTS (SELECT 1 FROM lin WHERE lin.item_id = a.item_id AND lin.label = a.label AND lin.n > 1) AS conflict, a.n_top > 1 AS top_conflict
FROM (SELECT k.item_id, k.label, count(DISTINCT k.sk) AS n_ext, count(DISTINCT CASE WHEN k.priority = m.p THEN k.sk END) AS n_top FROM keyed k
  JOIN (SELECT item_id, label, max(priority) AS p FROM keyed WHERE kind = 'extracted' GROUP BY 1, 2) m ON m.item_id = k.item_id AND m.label = k.label WHERE k.kind = 'extracted' GROUP BY 1, 2) a
LEFT JOIN first_verdict v ON v.item_id = a.item_id AND v.label = a.label"""


def listed(t):
    """Candidates over extracted values that are numbered and written once; both forms of a value are read from there, so nothing is joined."""
    own = t.by_order().hold(extracted=["item_id", "label", "idx", "value", "uom", "source_type"]).extracted
    forms = t.given(extracted=own.withColumn("excerpt", F.lit(None).cast("string")))
    return adj.listed(forms.extracted, forms.normalized)


def written(t):
    """Candidates and conflict state, written once for the steps that read them often."""
    c = listed(t)
    return c, stored(adj.conflicts(c, ver.first_verdicts(t.verdicts, t.failed_items), "ambiguous"), "conflicts")


@query("adj_conflict", "SELECT * FROM state")
def _(t):
    out = adj.conflicts(listed(t), ver.first_verdicts(t.verdicts, t.failed_items), "ambiguous")
    return out.select("item_id", "label", "entailment", "conflict", "top_conflict")


FRAGMENTS["passed"] = """SELECT item_id, label, candidate_id, value, uom, source_type, priority FROM cands JOIN (SELECT item_id, label FROM state WHERE NOT conflict) s USING (item_id, label)
QUALIFY row_number() OVER (PARTITION BY item_id, label ORDER BY priority DESC, kind = 'normalized' DESC, lineage) = 1"""


@query("adj_pass", "SELECT * FROM passed")
def _(t):
    return adj.passthrough(*written(t))


VIEWS["decision_rows"] = """
SELECT item_id, label, CASE (item_id * 7 + length(label)) % 6 WHEN 0 THEN 'extracted:0' WHEN 1 THEN 'normalized:0' WHEN 2 THEN NULL WHEN 3 THEN 'extracted:1' ELSE 'extracted:0' END AS selected_candidate_id,
  (item_id + length(label)) % 9 = 0 AS needs_human_review, 'picked for ' || label AS reasoning, ids
FROM (SELECT item_id, label, string_agg(candidate_id, ',') AS ids FROM {cands} GROUP BY item_id, label) x
"""
# decisions exist for every conflict label, except for items that got one too few or one twice
FRAGMENTS["decisions"] = """SELECT d.item_id, d.label, selected_candidate_id, needs_human_review, reasoning, list_sort(list_filter(string_split(ids, ','), lambda i: i IS DISTINCT FROM selected_candidate_id AND NOT (d.item_id % 8 = 1 AND i = 'normalized:0'))) AS rej
FROM decision_rows d JOIN state s ON s.item_id = d.item_id AND s.label = d.label AND s.conflict WHERE NOT (d.item_id % 10 = 3 AND d.label = 'Size')"""


def decisions(t, c, st):
    """Decisions on the written candidates, written once."""
    d = t.spark.sql(VIEWS["decision_rows"], cands=c).join(st.where("conflict").select("item_id", "label"), ["item_id", "label"], "left_semi")
    d = d.where(~((F.col("item_id") % 10 == 3) & (F.col("label") == "Size")))
    rej = F.filter(F.split("ids", ","), lambda i: ~i.eqNullSafe(F.col("selected_candidate_id"))
                   & ~((F.col("item_id") % 8 == 1) & (i == "normalized:0")))
    return stored(d.withColumn("rejected_candidate_ids", rej).drop("ids"), "decisions")


FRAGMENTS["part_ok"] = """SELECT d.*, (d.selected_candidate_id IS NULL OR list_contains(c.ids, d.selected_candidate_id)) AND d.rej = list_filter(c.ids, lambda i: i IS DISTINCT FROM d.selected_candidate_id) AS ids_ok
FROM decisions d JOIN (SELECT item_id, label, list_sort(list(candidate_id)) AS ids FROM cands GROUP BY 1, 2) c ON c.item_id = d.item_id AND c.label = d.label"""
FRAGMENTS["match_ok"] = """SELECT s.item_id, bool_and(d.label IS NOT NULL) AS labels_match FROM (SELECT * FROM state WHERE conflict) s LEFT JOIN decisions d ON d.item_id = s.item_id AND d.label = s.label GROUP BY 1"""


@query("set_partition", "SELECT item_id, label, ids_ok FROM part_ok")
def _(t):
    c, st = written(t)
    return adj.ids_partition(c, decisions(t, c, st)).select("item_id", "label", "ids_ok")


@query("set_label_match", "SELECT item_id, labels_match FROM match_ok")
def _(t):
    c, st = written(t)
    return adj.decision_sets_match(st, decisions(t, c, st))


FRAGMENTS["settled0"] = """SELECT s.item_id, s.label, s.entailment, s.top_conflict, p.label IS NOT NULL AS given, coalesce(p.ids_ok, false) AS ok, p.needs_human_review AS nhr, p.reasoning,
 c.candidate_id AS pid, c.priority AS pp, t.candidate_id AS tid, t.priority AS tp
FROM (SELECT * FROM state WHERE conflict) s
LEFT JOIN (SELECT part_ok.* FROM part_ok JOIN match_ok m ON m.item_id = part_ok.item_id AND m.labels_match) p ON p.item_id = s.item_id AND p.label = s.label
LEFT JOIN cands c ON c.item_id = s.item_id AND c.label = s.label AND c.candidate_id = p.selected_candidate_id
LEFT JOIN (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY item_id, label ORDER BY priority DESC, kind = 'normalized' DESC, lineage) = 1) t ON t.item_id = s.item_id AND t.label = s.label"""
FRAGMENTS["settled"] = """SELECT item_id, label, CASE WHEN keep AND pp < tp THEN tid WHEN keep THEN pid END AS chosen_id,
 NOT given OR nhr OR NOT ok OR coalesce(pid IS NULL AND entailment IN ('supported', 'partially_supported'), false) OR coalesce(entailment = 'ambiguous', true) OR top_conflict AS needs_review,
 concat_ws(' ', CASE WHEN NOT given THEN 'Missing adjudication decision.' WHEN NOT ok THEN 'Adjudication response referenced an invalid or incomplete candidate set.' ELSE reasoning END,
  CASE WHEN coalesce(entailment = 'ambiguous', true) THEN 'Ambiguous evidence requires human review.' WHEN entailment = 'not_supported' THEN 'Unsupported evidence was rejected.' END,
  CASE WHEN top_conflict THEN 'Top-priority sources conflict.' END, CASE WHEN keep AND pp < tp THEN 'Overridden by mandatory manufacturer-source priority.' END) AS reason
FROM (SELECT *, given AND ok AND pid IS NOT NULL AND coalesce(entailment IN ('supported', 'partially_supported'), false) AND NOT top_conflict AS keep FROM settled0) z"""


def settled(t):
    c, st = written(t)
    return c, st, adj.settle(c, st, decisions(t, c, st))


@query("adj_apply", "SELECT item_id, label, chosen_id, needs_review, reason FROM settled")
def _(t):
    return settled(t)[2].select("item_id", "label", "chosen_id", "needs_review", "reason")


@query("adj_rejected", "SELECT c.item_id, c.label, c.candidate_id, coalesce(c.value, '') AS value, s.reason, c.source_type FROM cands c JOIN settled s ON s.item_id = c.item_id AND s.label = c.label WHERE c.candidate_id IS DISTINCT FROM s.chosen_id")
def _(t):
    c, _, s = settled(t)
    return adj.rejected(c, s)


@query("adj_final", """SELECT item_id, label, candidate_id, value, uom, source_type, priority FROM passed UNION ALL
SELECT c.item_id, c.label, c.candidate_id, c.value, c.uom, c.source_type, c.priority FROM cands c JOIN settled s ON s.item_id = c.item_id AND s.label = c.label AND c.candidate_id = s.chosen_id""")
def _(t):
    c, st, s = settled(t)
    return adj.final_attributes(c, st, stored(s, "settled"))
