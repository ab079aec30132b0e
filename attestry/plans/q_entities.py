"""Queries over entity vocabularies, resolution, lookups and web evidence."""

from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions import text as tx
from attestry.functions import web
from attestry.operators import cleaning, entities as en, evidence as ev
from attestry.plans.adapters import VIEWS
from attestry.plans.q_text import d_clean, d_collapse, d_display, d_domain, d_fold, d_key, d_placeholder, page_links
from attestry.plans.q_units import d_indel
from attestry.plans.registry import FRAGMENTS, query
from attestry.session import cut_lineage, scratch_path
from attestry.sources import reference as ref

FRAGMENTS["truth_names"] = f"""SELECT row_no, CASE WHEN NOT {d_placeholder('m')} THEN m END AS m, CASE WHEN NOT {d_placeholder('b')} THEN b END AS b
FROM (SELECT row_no, {d_clean('manufacturer_name')} AS m, {d_clean('brand_name')} AS b FROM truth) x"""
FRAGMENTS["obs"] = """SELECT kind, source, value FROM (
 SELECT 'brand' AS kind, 'catalog' AS source, unnest([e1_brand, unilog_brand, dib_brand]) AS value FROM cleaned
 UNION ALL SELECT 'manufacturer', 'catalog', part_manuf FROM cleaned
 UNION ALL SELECT 'manufacturer', 'truth', m FROM truth_names UNION ALL SELECT 'brand', 'truth', b FROM truth_names) o WHERE value IS NOT NULL"""
FRAGMENTS["sp"] = f"""SELECT c AS value, count(*) AS n, {d_key('c')} AS key FROM spelt WHERE NOT {d_placeholder('c')} GROUP BY c"""
FRAGMENTS["pairs_ok"] = f"SELECT {d_key('b')} AS brand_key, arg_max(m, row_no) AS manufacturer FROM truth_names WHERE m IS NOT NULL AND b IS NOT NULL GROUP BY 1"

VIEWS["master"] = """
SELECT p_partkey AS row_no, CASE p_partkey % 41 WHEN 0 THEN 'N/A' ELSE 'M' || CAST(p_partkey % 90 AS STRING) END AS mfr_id,
  'Maker ' || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' Inc' WHEN 1 THEN ', Ltd.' ELSE ' & Sons' END AS manufacturer,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'B' || CAST(p_partkey % 70 AS STRING) END AS brand_code, p_brand AS brand
FROM {part}
"""
VIEWS["lookup_cache"] = """
SELECT 'pn' || CAST(p_partkey AS STRING) || 'a' AS part_key, CASE p_partkey % 3 WHEN 1 THEN NULL ELSE 'Found ' || p_brand END AS manufacturer,
  CASE p_partkey % 3 WHEN 1 THEN NULL ELSE 0.93 END AS confidence, p_partkey AS stored_at
FROM {part} WHERE p_partkey % 3 <> 2
"""
FRAGMENTS["master_rows"] = f"""SELECT row_no, CASE WHEN NOT {d_placeholder(d_clean('mfr_id'))} THEN {d_clean('mfr_id')} END AS mid, {d_clean('manufacturer')} AS mname,
 {d_clean('brand_code')} AS bid, {d_clean('brand')} AS bname FROM master"""
FRAGMENTS["master_ids"] = f"""SELECT kind, key, arg_max(value, row_no) AS value FROM (
 SELECT row_no, 'manufacturer_id' AS kind, {d_key('mname')} AS key, mid AS value FROM master_rows WHERE mid IS NOT NULL
 UNION ALL SELECT row_no, 'brand_id', {d_key('bname')}, bid FROM master_rows WHERE mid IS NOT NULL AND bid IS NOT NULL
 UNION ALL SELECT row_no, 'brand_owner', {d_key('bname')}, mname FROM master_rows WHERE mid IS NOT NULL AND bid IS NOT NULL) x GROUP BY kind, key"""


def observed(t):
    return en.observations(t.catalog, t.truth)


def spelling_counts(t):
    return en.count_spellings(en.cleaned_spellings(t.spellings), [])


# ---- observations and vocabularies ---------------------------------------------------

@query("agg_observe", f"SELECT kind, value, count(*) AS n FROM obs WHERE {d_key('value')} <> '' GROUP BY kind, value")
def _(t):
    return en.count_spellings(observed(t)).drop("key")


@query("set_union_obs", "SELECT kind, source, count(*) AS n, count(DISTINCT value) AS spellings FROM obs GROUP BY kind, source")
def _(t):
    return observed(t).groupBy("kind", "source").agg(F.count("*").alias("n"), F.count_distinct("value").alias("spellings"))


CANON = f"""SELECT {{by}}key, arg_min({d_display('value')}, ROW(-n, length({d_display('value')}), {d_fold(d_display('value'))}, value)) AS canonical_name,
 sum(n)::BIGINT AS frequency, string_agg(value, '|' ORDER BY {d_fold('value')}, value) AS aliases FROM {{src}} GROUP BY {{by}}key"""


@query("agg_canonical", CANON.format(by="", src="sp") )
def _(t):
    return en.canonical_entries(spelling_counts(t), [], "key").withColumn("aliases", F.array_join("aliases", "|"))


_VOCABULARY = CANON.format(by="kind, ", src=f"(SELECT kind, value, count(*) AS n, {d_key('value')} AS key FROM obs GROUP BY kind, value) z WHERE key <> ''")


@query("sort_vocab", _VOCABULARY + " ORDER BY lower(canonical_name)")
def _(t):
    return en.ordered(en.exact_vocabulary(observed(t), ["kind"])).withColumn("aliases", F.array_join("aliases", "|"))




def clusters(tag: str) -> None:
    """Leader clusters of the counted spellings `{tag}sp`: ranked spellings, near keys, leaders, and each spelling's leader."""
    FRAGMENTS[f"{tag}rk"] = f"SELECT value, n, key, row_number() OVER (ORDER BY -n, {d_fold('value')}, value) AS r FROM {tag}sp WHERE key <> ''"
    FRAGMENTS[f"{tag}kr"] = f"SELECT key, min(r) AS kr FROM {tag}rk GROUP BY key"
    FRAGMENTS[f"{tag}near"] = f"""SELECT a, b, {d_indel('a', 'b')} AS score FROM (SELECT x.key AS a, y.key AS b FROM {tag}kr x JOIN {tag}kr y
  ON x.key <> y.key AND abs(length(x.key) - length(y.key)) <= 3 AND levenshtein(x.key, y.key) <= 4) p WHERE {d_indel('a', 'b')} >= 96"""
    FRAGMENTS[f"{tag}ord"] = f"SELECT list(key ORDER BY kr) AS ks, (SELECT coalesce(list(a || '|' || b), []) FROM {tag}near) AS nl FROM {tag}kr"
    FRAGMENTS[f"{tag}lead"] = f"""SELECT unnest(list_reduce(ks, lambda l, k: CASE WHEN list_has_any(list_transform(l, lambda x: x || '|' || k), nl) THEN l ELSE list_append(l, k) END, []::VARCHAR[])) AS leader FROM {tag}ord"""
    FRAGMENTS[f"{tag}assigned"] = f"""SELECT value, n, arg_min(leader, ROW(-score, lr)) AS leader FROM (
  SELECT k.value, k.n, leader, 100.0 AS score, kr AS lr FROM {tag}rk k JOIN {tag}lead ON k.key = leader JOIN {tag}kr q ON q.key = leader
  UNION ALL SELECT k.value, k.n, leader, m.score, q.kr FROM {tag}rk k JOIN {tag}near m ON m.a = k.key JOIN {tag}lead ON leader = m.b JOIN {tag}kr q ON q.key = leader
    WHERE q.kr < k.r AND k.key NOT IN (SELECT leader FROM {tag}lead)) o GROUP BY value, n"""


clusters("")
for _kind in ("brand", "manufacturer"):
    FRAGMENTS[f"{_kind}_sp"] = f"SELECT value, count(*) AS n, {d_key('value')} AS key FROM obs WHERE kind = '{_kind}' GROUP BY value"
    clusters(f"{_kind}_")
    FRAGMENTS[f"{_kind}_vocab"] = CANON.format(by="", src=f"(SELECT value, n, leader AS key FROM {_kind}_assigned) z")
    # a key that leads no cluster is nearest to one that does, at the ratio of both: token scores end at 95
    FRAGMENTS[f"{_kind}_found"] = f"""SELECT key, arg_min(canonical_name, ROW(-score, {d_fold('canonical_name')}, canonical_name)) AS canonical_name, max(score) / 100 AS score FROM (
  SELECT key, canonical_name, 100.0::DOUBLE AS score FROM {_kind}_vocab UNION ALL SELECT n.a, v.canonical_name, n.score FROM {_kind}_near n JOIN {_kind}_vocab v ON v.key = n.b
  WHERE n.a NOT IN (SELECT key FROM {_kind}_vocab)) f GROUP BY key"""


@query("ent_cluster", "SELECT value, n, leader FROM assigned")
def _(t):
    return en.assign_leaders(spelling_counts(t)).select("value", "n", "leader")


@query("agg_alias_stats", f"""WITH e AS ({CANON.format(by='', src='(SELECT value, n, leader AS key FROM assigned) z').replace("string_agg(value, '|'", "list(value")}),
r AS (SELECT key, CASE WHEN {d_display('alias')} = canonical_name THEN 'c' WHEN {d_key('alias')} = key THEN 'r' ELSE 'f' END AS reason
  FROM (SELECT key, canonical_name, unnest(aliases) AS alias FROM e) x)
SELECT count(DISTINCT key) AS entries, count(*) AS aliases, count(*) FILTER (reason = 'f') AS fuzzy, count(*) FILTER (reason = 'r') AS by_rule,
 round(100.0 * count(*) FILTER (reason = 'f') / count(*), 2) AS fuzzy_percent FROM r""")
def _(t):
    return en.alias_stats(en.build_vocabulary(en.cleaned_spellings(t.spellings)))


@query("snk_vocab_artifacts", _VOCABULARY)
def _(t):
    path = scratch_path(t.spark, "vocabulary-json")
    en.exact_vocabulary(observed(t), ["kind"]).write.partitionBy("kind").json(path)
    back = t.spark.read.schema("key string, canonical_name string, frequency bigint, aliases array<string>, kind string").json(path)
    return back.withColumn("aliases", F.array_join("aliases", "|"))


# ---- reference files, pairing, ids -------------------------------------------------------

@query("src_entity_master", "SELECT kind, key, value FROM master_ids")
def _(t):
    return ref.entity_master(t.master)


@query("join_pairing", f"SELECT row_no, b, manufacturer FROM (SELECT row_no, coalesce(e1_brand, unilog_brand, dib_brand) AS b FROM cleaned) c LEFT JOIN pairs_ok ON brand_key = {d_key('b')}")
def _(t):
    c = cleaning.clean_catalog(t.catalog).select("row_no", F.coalesce(*en.BRAND_FIELDS).alias("b"))
    keyed = c.withColumn("brand_key", tx.entity_key(F.col("b")))
    return keyed.join(en.pairing(t.truth), "brand_key", "left").select("row_no", "b", "manufacturer")


@query("join_ids", f"""SELECT row_no, m AS manufacturer, i.value AS manufacturer_id, b AS brand, j.value AS brand_id FROM truth_names
 LEFT JOIN master_ids i ON i.kind = 'manufacturer_id' AND i.key = {d_key('m')} LEFT JOIN master_ids j ON j.kind = 'brand_id' AND j.key = {d_key('b')}""")
def _(t):
    ids = ref.entity_master(t.master)
    of = lambda kind: ids.where(F.col("kind") == kind).select("key", F.col("value").alias("id"))
    names = t.truth.select("row_no", tx.clean_optional(F.col("manufacturer_name")).alias("manufacturer"),
                           tx.clean_optional(F.col("brand_name")).alias("brand"))
    out = en.attach_ids(names, "manufacturer", of("manufacturer_id"), "manufacturer_id")
    return en.attach_ids(out, "brand", of("brand_id"), "brand_id")


# ---- lookups -----------------------------------------------------------------------------

@query("join_lookup_cache", f"""WITH k AS (SELECT row_no, regexp_replace(coalesce({d_fold('mfg_part_num')}, ''), '[^a-z0-9]+', '', 'g') AS part_key FROM cleaned)
SELECT k.row_no, k.part_key, manufacturer AS found, confidence AS found_confidence,
 CASE WHEN k.part_key <> '' THEN CASE WHEN c.part_key IS NOT NULL THEN 'hit' ELSE 'miss' END END AS cache_state FROM k LEFT JOIN lookup_cache c USING (part_key)""")
def _(t):
    out = en.with_lookup(cleaning.clean_catalog(t.catalog), t.lookup_cache)
    return out.select("row_no", "part_key", "found", "found_confidence",
                      F.when(F.col("cache_hit"), "hit").when(~F.col("cache_hit"), "miss").alias("cache_state"))


@query("snk_lookup_cache", f"""WITH work AS (SELECT DISTINCT regexp_replace({d_fold('mfg_part_num')}, '[^a-z0-9]+', '', 'g') AS part_key FROM cleaned
  WHERE regexp_replace({d_fold('mfg_part_num')}, '[^a-z0-9]+', '', 'g') NOT IN (SELECT part_key FROM lookup_cache)),
fresh AS (SELECT part_key, NULL AS manufacturer, NULL::DECIMAL(3,2) AS confidence, 1000000000 AS stored_at FROM work
  UNION ALL SELECT part_key, 'Renewed', 0.95, 1000000001 FROM lookup_cache WHERE stored_at % 10 = 0)
SELECT part_key, manufacturer, confidence, stored_at FROM (SELECT * FROM lookup_cache UNION ALL SELECT * FROM fresh) u
QUALIFY row_number() OVER (PARTITION BY part_key ORDER BY stored_at DESC) = 1""")
def _(t):
    path = scratch_path(t.spark, "lookup-cache")
    old = t.lookup_cache
    work = en.lookup_work(cleaning.clean_catalog(t.catalog), old)
    answer = lambda df, m, c, at: df.select("part_key", F.lit(m).cast("string").alias("manufacturer"), F.lit(c).cast("double").alias("confidence"), F.lit(at).cast("bigint").alias("stored_at"))
    fresh = answer(work, None, None, 1_000_000_000).unionByName(
        answer(old.where(F.col("stored_at") % 10 == 0), "Renewed", 0.95, 1_000_000_001))
    merged = en.merge_lookups(old.withColumn("confidence", F.col("confidence").cast("double")), fresh)
    merged.write.parquet(path)  # a new path, so readers of the old table are not disturbed
    return t.spark.read.parquet(path)


# ---- ranking and resolution ----------------------------------------------------------

def brand_vocabulary(t):
    return en.build_vocabulary(observed(t).where(F.col("kind") == "brand"))


@query("join_fuzzy_top3")
def _(t):
    c = cleaning.clean_catalog(t.catalog)
    keys = c.select(F.explode(F.array(*en.BRAND_FIELDS)).alias("v")).select(tx.entity_key(F.col("v")).alias("key")).where("key <> ''")
    return en.rank_names(keys, brand_vocabulary(t)).select("key", "rank", "canonical_name", F.round("score", 6).alias("score"))


@query("win_rank3", """WITH b AS (SELECT l_orderkey AS item, 'Supplier ' || (l_suppkey % 7) AS canonical_name, max(l_discount) AS score FROM lineitem GROUP BY 1, 2)
SELECT item, canonical_name, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, canonical_name) AS rank FROM b
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, canonical_name) <= 3""")
def _(t):
    scored = t.lineitem.select(F.col("l_orderkey").alias("item"),
                               F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 7).cast("string")).alias("canonical_name"),
                               F.col("l_discount").alias("score"))
    return en.top_candidates(scored, "item")


FRAGMENTS["brand_res"] = f"""SELECT row_no, CASE WHEN count(DISTINCT canonical_name) = 1 THEN min(canonical_name) END AS brand, max(score) AS score, count(DISTINCT canonical_name) > 1 AS conflict
 FROM (SELECT row_no, unnest([e1_brand, unilog_brand, dib_brand]) AS v FROM cleaned) e JOIN brand_found ON key = {d_key('v')} GROUP BY row_no"""
FRAGMENTS["resolved"] = f"""SELECT c.row_no, brand, CASE WHEN brand IS NULL THEN 0.0 ELSE b.score END AS brand_confidence, coalesce(conflict, false) AS conflict,
 coalesce(p.manufacturer, lc.manufacturer, v.canonical_name) AS manufacturer,
 CASE WHEN p.manufacturer IS NOT NULL THEN 0.98 WHEN lc.manufacturer IS NOT NULL THEN lc.confidence WHEN v.canonical_name IS NOT NULL THEN 0.65 ELSE 0.0 END AS manufacturer_confidence,
 CASE WHEN p.manufacturer IS NOT NULL THEN 'brand_manufacturer_pair' WHEN lc.manufacturer IS NOT NULL THEN 'mpn_web_lookup' WHEN v.canonical_name IS NOT NULL THEN 'part_manuf_fallback' END AS source
FROM cleaned c LEFT JOIN brand_res b USING (row_no) LEFT JOIN pairs_ok p ON p.brand_key = {d_key('b.brand')}
LEFT JOIN lookup_cache lc ON lc.part_key = regexp_replace({d_fold('c.mfg_part_num')}, '[^a-z0-9]+', '', 'g') AND p.manufacturer IS NULL AND coalesce(e1_brand, unilog_brand, dib_brand) IS NULL
LEFT JOIN manufacturer_found v ON v.key = {d_key('c.part_manuf')}"""


def resolved(t):
    """Cleaned rows and counted spellings are written once; everything else reads them.  Names resolve to clusters of spellings."""
    cleaned = cut_lineage(cleaning.clean_catalog(t.catalog))
    counted = cut_lineage(en.count_spellings(en.observations(cleaned, t.truth, cleaned=True)))
    of = lambda kind: en.canonical_entries(en.assign_leaders(counted.where(F.col("kind") == kind).drop("kind")))
    return en.resolve_catalog(cleaned, of("brand"), of("manufacturer"), en.pairing(t.truth), t.lookup_cache)


@query("ent_resolve_brand", """SELECT row_no, brand, CASE WHEN brand IS NULL THEN 0.0 ELSE round(score, 6) END AS confidence, conflict, i.value AS brand_id
FROM brand_res LEFT JOIN master_ids i ON i.kind = 'brand_id' AND i.key = """ + d_key("brand"))
def _(t):
    c = cleaning.clean_catalog(t.catalog).select("row_no", F.explode(F.array(*en.BRAND_FIELDS)).alias("value"))
    found = en.resolve_names(c, brand_vocabulary(t), 0.86).select("row_no", F.col("canonical_name").alias("brand"), F.round("confidence", 6).alias("confidence"), "conflict")
    return en.attach_ids(found, "brand", ids_of(t, "brand_id"), "brand_id")


def ids_of(t, kind):
    return ref.entity_master(t.master).where(F.col("kind") == kind).select("key", F.col("value").alias("id"))


@query("ent_resolve_mfr", f"""SELECT row_no, brand, round(brand_confidence, 6) AS brand_confidence, manufacturer, manufacturer_confidence, source, i.value AS manufacturer_id, j.value AS brand_id FROM resolved
 LEFT JOIN master_ids i ON i.kind = 'manufacturer_id' AND i.key = {d_key('manufacturer')} LEFT JOIN master_ids j ON j.kind = 'brand_id' AND j.key = {d_key('brand')}""")
def _(t):
    r = resolved(t).select("row_no", "brand", F.round("brand_confidence", 6).alias("brand_confidence"), "manufacturer", "manufacturer_confidence",
                           F.col("manufacturer_source").alias("source"))
    return en.attach_ids(en.attach_ids(r, "manufacturer", ids_of(t, "manufacturer_id"), "manufacturer_id"), "brand", ids_of(t, "brand_id"), "brand_id")


@query("ent_flags", """SELECT row_no, 'manufacturer_unresolved' AS code, 'manufacturer' AS field FROM resolved WHERE manufacturer IS NULL OR manufacturer_confidence < 0.86
UNION ALL SELECT row_no, 'low_confidence_distributor_field_used', 'manufacturer' FROM resolved WHERE source = 'part_manuf_fallback'
UNION ALL SELECT row_no, 'brand_unresolved', 'brand' FROM resolved WHERE brand IS NULL UNION ALL SELECT row_no, 'brand_conflict', 'brand' FROM resolved WHERE conflict""")
def _(t):
    return en.resolution_flags(resolved(t))


# ---- web evidence --------------------------------------------------------------------------

def search_results(t):
    m = F.when(F.col("page_id") % 7 == 0, "Company Manufacturing").when(F.col("page_id") % 5 == 0, "The Und Co.").otherwise(
        F.concat(F.lit("Site"), (F.col("page_id") % 17).cast("string"), F.lit(" Manufacturing Company")))
    return page_links(t).select("page_id", F.col("pos").alias("rank"), "url", "title", m.alias("manufacturer"),
                                (F.col("pos") % 2).alias("query_no"),
                                F.concat(F.lit("site"), (F.col("page_id") % 17).cast("string"), F.lit(".example.com")).alias("owner"))


FRAGMENTS["results"] = """SELECT page_id, pos AS rank, pos % 2 AS query_no, url, title, 'site' || (page_id % 17) || '.example.com' AS owner,
 CASE WHEN page_id % 7 = 0 THEN 'Company Manufacturing' WHEN page_id % 5 = 0 THEN 'The Und Co.' ELSE 'Site' || (page_id % 17) || ' Manufacturing Company' END AS manufacturer FROM page_links"""
OVERLAP = f"""list_has_any(list_filter(string_split({d_key('manufacturer')}, ' '), lambda w: w NOT IN ('', 'company', 'corporation', 'manufacturing')),
  list_concat(string_split_regex({d_domain('url')}, '[^a-z0-9]+'), string_split({d_key('title')}, ' ')))"""
BLOCKED = " OR ".join(f"{d_domain('url')} = '{h}' OR ends_with({d_domain('url')}, '.{h}')" for h in fv.BLOCKED_HOSTS)


@query("set_token_overlap", f"SELECT page_id, rank, {OVERLAP} AS overlaps, {BLOCKED} AS blocked FROM results")
def _(t):
    r = search_results(t)
    return r.select("page_id", "rank", ev.name_overlap(F.col("manufacturer"), F.col("url"), F.col("title")).alias("overlaps"),
                    ev.is_blocked(F.col("url")).alias("blocked"))


@query("ent_domain", f"SELECT page_id, arg_min({d_domain('url')}, rank) AS domain FROM results WHERE {OVERLAP} AND NOT ({BLOCKED}) GROUP BY page_id")
def _(t):
    return ev.resolve_domains(search_results(t), "page_id")


@query("top_links", f"""WITH g AS (SELECT * FROM results WHERE {d_domain('url')} = owner OR ends_with({d_domain('url')}, '.' || owner)),
f AS (SELECT page_id, min(query_no) AS query_no FROM g GROUP BY page_id), u AS (SELECT page_id, query_no, url, min(rank) AS rank FROM g JOIN f USING (page_id, query_no) GROUP BY 1, 2, 3)
SELECT page_id, query_no, url, rank, row_number() OVER (PARTITION BY page_id ORDER BY rank, url) AS n FROM u QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, url) <= 3""")
def _(t):
    return ev.official_links(search_results(t), "page_id")


VIEWS["snippets"] = """
SELECT doc_id, '<div class="result__snippet x">' || text || '</div>' AS html FROM {documents}
"""
# of four manufacturers, one is misspelt in one letter and one in three
VIEWS["quoted_names"] = """
SELECT item_id, substr(text, 3, 26) AS brand, CASE item_id % 4 WHEN 1 THEN substr(text, 12, 9) || '9' || substr(text, 22, 12)
  WHEN 2 THEN substr(text, 12, 4) || '9' || substr(text, 17, 6) || '9' || substr(text, 24, 6) || '9' || substr(text, 31, 3) ELSE substr(text, 12, 22) END AS manufacturer FROM {benchmark}
"""


# the partial ratio by definition: inside a text, over the windows that have enough of the name's letter pairs within the displacement that
# the ratio leaves; at its two ends, and in texts no longer than the name, over every window of which enough letter pairs are in the name
FRAGMENTS["evidence_keys"] = f"SELECT doc_id, {d_key(d_collapse('text'))} AS ek FROM documents"
FRAGMENTS["maker_keys"] = f"""SELECT key, name, length(key) AS m, CAST(floor(0.14 * length(key) + 1e-9) AS BIGINT) AS d, length(key) - 1 - 2 * CAST(floor(0.28 * length(key) + 1e-9) AS BIGINT) AS enough
 FROM (SELECT {d_key('manufacturer')} AS key, min(trim(manufacturer)) AS name FROM quoted_names GROUP BY 1) x WHERE key <> ''"""
FRAGMENTS["evidence_grams"] = "SELECT doc_id, substr(ek, i, 2) AS g, i AS p FROM (SELECT doc_id, ek, unnest(range(1, length(ek))) AS i FROM evidence_keys) a"
# the four commonest pairs of a name are left out where enough others remain: an edit spoils at most two pairs of any choice
FRAGMENTS["maker_grams"] = """SELECT key, g, o, m, d, enough - least(4, greatest(enough - 1, 0)) AS needed FROM (SELECT key, substr(key, i, 2) AS g, i AS o, m, d, enough
  FROM (SELECT *, unnest(range(1, m)) AS i FROM maker_keys) y) z LEFT JOIN (SELECT g, count(*) AS f FROM evidence_grams GROUP BY g) c USING (g)
 QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(f, 0) DESC, o) > least(4, greatest(enough - 1, 0))"""
FRAGMENTS["maker_windows"] = """SELECT DISTINCT doc_id, key, m, unnest(range(l[j + needed - 1] - d, l[j] + d + 1)) AS i FROM (
  SELECT doc_id, key, m, d, needed, l, unnest(list_filter(range(1, len(l) - needed + 2), lambda j: l[j + needed - 1] - l[j] <= 2 * d)) AS j FROM (
   SELECT doc_id, key, m, d, needed, list_sort(list(CAST(p - o AS INT))) AS l FROM evidence_grams JOIN maker_grams USING (g) GROUP BY ALL HAVING count(*) >= needed) h) r"""
FRAGMENTS["maker_ends"] = """SELECT doc_id, ek, key, m, i FROM (SELECT doc_id, ek, key, m, unnest(list_concat(range(shortest - m, 0), range(length(ek) - m + 1, length(ek) - shortest + 1))) AS i FROM (SELECT *, CAST(ceil(0.86 * m / 1.14 - 1e-9) AS BIGINT) AS shortest FROM (
   SELECT e.doc_id, any_value(ek) AS ek, b.key, any_value(b.m) AS m FROM evidence_keys e JOIN maker_grams b ON length(ek) > b.m AND (contains(left(ek, b.m), g) OR contains(right(ek, b.m), g))
    GROUP BY e.doc_id, b.key HAVING greatest(count(*) FILTER (contains(left(ek, b.m), g)), count(*) FILTER (contains(right(ek, b.m), g))) >= any_value(b.needed)) x) z) y"""
# of two strings at the ratio, the edit distance is at most 0.14 of both lengths
FRAGMENTS["maker_pairs"] = """SELECT * FROM (SELECT DISTINCT doc_id, ek, key AS a, substr(ek, greatest(i, 0) + 1, least(i + m, length(ek)) - greatest(i, 0)) AS b, key FROM (
   SELECT doc_id, ek, key, m, i FROM maker_windows JOIN evidence_keys USING (doc_id) WHERE i >= 0 AND i + m <= length(ek) UNION ALL SELECT * FROM maker_ends) w
 UNION SELECT DISTINCT doc_id, ek, ek, substr(key, greatest(i, 0) + 1, least(i + n, m) - greatest(i, 0)), key
  FROM (SELECT doc_id, ek, key, m, length(ek) AS n, unnest(range(1 - length(ek), m)) AS i FROM evidence_keys JOIN maker_keys ON length(ek) BETWEEN 1 AND m) s) p
 WHERE levenshtein(a, b) <= 0.14 * (length(a) + length(b)) + 1e-9"""
FRAGMENTS["maker_scores"] = f"SELECT doc_id, key, CASE WHEN contains(any_value(ek), key) THEN 0.93 ELSE max({d_indel('a', 'b')}) / 100 END AS score FROM maker_pairs GROUP BY doc_id, key"


@query("join_evidence", f"""WITH b AS (SELECT {d_key('brand')} AS key, min(trim(brand)) AS name FROM quoted_names GROUP BY 1),
p AS (SELECT {d_key('brand')} AS key, arg_max(trim(manufacturer), item_id) AS owner FROM quoted_names WHERE item_id % 3 = 0 GROUP BY 1),
vb AS (SELECT doc_id, arg_min(owner, ROW(lower(name), name)) AS owner FROM evidence_keys JOIN b ON b.key <> '' AND contains(ek, b.key) JOIN p USING (key) GROUP BY doc_id),
vm AS (SELECT doc_id, max(ROW(score, name)) AS best FROM maker_scores JOIN maker_keys USING (key) WHERE score >= 0.86 - 1e-11 GROUP BY doc_id)
SELECT doc_id, coalesce(owner, best[2]) AS manufacturer, round(CASE WHEN owner IS NOT NULL THEN 0.95 WHEN best IS NOT NULL THEN least(best[1], 0.93) END, 6) AS confidence
FROM evidence_keys LEFT JOIN vb USING (doc_id) LEFT JOIN vm USING (doc_id)""")
def _(t):
    e = ev.evidence_keys(t.snippets, "doc_id")
    q = t.quoted_names
    vocab = lambda c: q.groupBy(tx.entity_key(F.col(c)).alias("key")).agg(F.min(F.trim(c)).alias("canonical_name"))
    pairs = q.where(F.col("item_id") % 3 == 0).groupBy(tx.entity_key(F.col("brand")).alias("brand_key")).agg(
        F.max_by(F.trim("manufacturer"), "item_id").alias("manufacturer"))
    found = ev.mentioned_manufacturer(e, vocab("brand"), vocab("manufacturer"), pairs, "doc_id")
    return found.withColumn("confidence", F.round("confidence", 6))


# ---- flagship ------------------------------------------------------------------------------

@query("flagship", """SELECT coalesce(brand, '(none)') AS brand, count(*) AS rows, count(*) FILTER (manufacturer_confidence >= 0.86) AS manufacturer_ok,
 round_even(100.0 * (count(*) FILTER (manufacturer_confidence >= 0.86) + count(brand)) / (2 * count(*)), 2) AS coverage_percent, count(*) FILTER (conflict) AS conflicts
FROM resolved GROUP BY 1""")
def _(t):
    r = resolved(t)
    ok = F.count_if(F.col("manufacturer_confidence") >= 0.86)
    return r.groupBy(F.coalesce("brand", F.lit("(none)")).alias("brand")).agg(
        F.count("*").alias("rows"), ok.alias("manufacturer_ok"),
        F.bround(100.0 * (ok + F.count_if(F.col("brand").isNotNull())) / (2 * F.count("*")), 2).alias("coverage_percent"),
        F.count_if("brand_conflict").alias("conflicts"))
