"""Queries over units, fractions, vectors, similarity, JSON, arrays and maps."""

from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions import similarity as sim
from attestry.functions import text as tx
from attestry.functions import units as un
from attestry.functions import vectors as vec
from attestry.operators import payloads
from attestry.operators.matching import contains_join, pair_cosine
from attestry.plans.adapters import VIEWS
from attestry.plans.q_text import d_collapse, d_fold
from attestry.plans.registry import FRAGMENTS, query


# ---- check-side expressions ----------------------------------------------------------

def d_unit(x):
    key = d_fold(d_collapse(x))
    arms = " ".join("WHEN k IN (%s) THEN '%s'" % (", ".join("'" + a.replace("'", "''") + "'" for a in (u.lower(), *al)), u)
                    for u, al in fv.UNITS.items())
    return "(SELECT CASE " + arms + f" END FROM (SELECT {key} AS k) ux)"


_TAIL = (r"(?i)^(.*\d)\s*(" + fv.TRAILING_UNITS + ")$").replace("'", "''")


def d_frac(x):
    s = f"floor(abs({x}::DECIMAL(30,14)) * 64 + 0.5)::BIGINT"
    return (f"(SELECT CASE WHEN neg THEN '-' ELSE '' END || CASE WHEN n = 0 THEN w::VARCHAR WHEN w > 0 THEN w || '-' || (n // g) || '/' || (64 // g)"
            f" ELSE (n // g) || '/' || (64 // g) END FROM (SELECT neg, w, n, gcd(n, 64::BIGINT) AS g FROM (SELECT {x}::DECIMAL(30,14) < 0 AS neg, {s} // 64 AS w, {s} % 64 AS n) f1) f2)")


def d_frac_text(x):
    tok = r"CASE WHEN regexp_full_match(tw, '-?\d+\.\d+') THEN " + (
        "(CASE WHEN tw::DECIMAL(30,14) < 0 THEN '-' ELSE '' END || CASE WHEN {s} % 64 = 0 THEN ({s} // 64)::VARCHAR WHEN {s} // 64 > 0 THEN ({s} // 64) || '-' || (({s} % 64) // gcd({s} % 64, 64)) || '/' || (64 // gcd({s} % 64, 64)) ELSE (({s} % 64) // gcd({s} % 64, 64)) || '/' || (64 // gcd({s} % 64, 64)) END)"
    ).replace("{s}", "floor(abs(tw::DECIMAL(30,14)) * 64 + 0.5)::BIGINT") + " ELSE tw END"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda tw: {tok}), ' ')"


def split_views(source, key, label="label", value="value", uom="uom", tag="m"):
    """CTE bodies: {tag}_split (split value/unit) and {tag}_norm (with the fraction rule)."""
    dims = " OR ".join(f"contains(lower({label}), '{w}')" for w in fv.DIMENSION_WORDS)
    FRAGMENTS[f"{tag}_parts"] = (
        f"SELECT {key}, {label}, {value} AS raw_value, {uom} AS raw_uom, {d_collapse(value)} AS txt, {d_unit(uom)} AS explicit, "
        f"regexp_matches({d_collapse(value)}, '{_TAIL}') AS has_tail, {d_unit(f'''regexp_extract({d_collapse(value)}, '{_TAIL}', 2)''')} AS tail, "
        f"trim(regexp_extract({d_collapse(value)}, '{_TAIL}', 1)) AS head FROM {source}")
    bad = "(coalesce(length(raw_uom) > 0, false) AND explicit IS NULL) OR (has_tail AND explicit IS NOT NULL AND tail IS DISTINCT FROM explicit)"
    FRAGMENTS[f"{tag}_split"] = (
        f"SELECT {key}, {label}, raw_value, raw_uom, CASE WHEN has_tail AND NOT ({bad}) THEN head ELSE txt END AS value, "
        f"CASE WHEN {bad} THEN NULL WHEN has_tail THEN tail ELSE explicit END AS uom, NOT ({bad}) AS valid FROM {tag}_parts")
    FRAGMENTS[f"{tag}_norm"] = (
        f"SELECT {key}, {label}, raw_value, raw_uom, CASE WHEN raw_value IS NULL THEN '' WHEN coalesce(uom IN ('in', 'ft'), false) OR {dims} THEN {d_frac_text('value')} ELSE value END AS value, "
        f"CASE WHEN raw_value IS NOT NULL THEN uom END AS uom, raw_value IS NOT NULL AND valid AS valid FROM {tag}_split")


split_views("measures", "item_id, line, partkey, suppkey")
_KEY = ["item_id", "line", "partkey", "suppkey"]
_K = ", ".join(_KEY)


@query("uom_canon", f"SELECT {_K}, {d_unit('uom')} AS unit FROM measures")
def _(t):
    return t.measures.select(*_KEY, un.canonical_unit(F.col("uom")).alias("unit"))


@query("uom_split", f"SELECT {_K}, value, uom, valid FROM m_split")
def _(t):
    m = un.split_measure(F.col("value"), F.col("uom"))
    return t.measures.select(*_KEY, m.alias("m")).select(*_KEY, "m.*")


@query("num_fraction", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {d_frac('(l_extendedprice::DECIMAL(12,2) / 7 - 900)::DECIMAL(20,10)')} AS fraction, {d_frac('l_tax::DECIMAL(12,2)')} AS small FROM lineitem")
def _(t):
    price = (F.col("l_extendedprice").cast("decimal(12,2)").cast("double") / 7 - 900)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             un.mixed_fraction(price.cast("decimal(20,10)")).alias("fraction"),
                             un.mixed_fraction(F.col("l_tax").cast("decimal(12,2)")).alias("small"))


@query("num_fraction_text", f"SELECT {_K}, {d_frac_text(d_collapse('value'))} AS text FROM measures")
def _(t):
    return t.measures.select(*_KEY, un.fractions_in_text(tx.collapse(F.col("value"))).alias("text"))


@query("num_format", f"SELECT {_K}, CASE WHEN uom IS NOT NULL AND uom <> '' THEN value || ' ' || uom ELSE value END AS text FROM measures")
def _(t):
    return t.measures.select(*_KEY, un.format_measure(F.col("value"), F.col("uom")).alias("text"))


@query("num_normalize", f"SELECT {_K}, value, uom, valid FROM m_norm")
def _(t):
    m = un.normalize_measure(F.col("label"), F.col("value"), F.col("uom"))
    return t.measures.select(*_KEY, m.alias("m")).select(*_KEY, "m.*")


@query("num_tier_clamp", """SELECT event_id, CASE WHEN value / 50 >= 0.95 THEN 'high' WHEN value / 50 >= 0.80 THEN 'medium' ELSE 'low' END AS tier,
 least(greatest(value / 50 - 0.1, 0), 1) AS clamped FROM events""")
def _(t):
    v = F.col("value") / 50
    return t.events.select("event_id", payloads.confidence_tier(v).alias("tier"),
                           payloads.clamp01(v - 0.1).alias("clamped"))


@query("vec_l2", """SELECT vec_id, pos, round(x / greatest(n, 1e-12), 6) AS x FROM (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos,
 sqrt(list_sum(list_transform(e, lambda z: z * z))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a) b""")
def _(t):
    unit = vec.l2_normalize(F.col("embedding"))
    return t.embeddings.select("vec_id", F.posexplode(unit).alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


# ---- similarity ------------------------------------------------------------------------

def d_lcs(a, b):
    return (f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_reduce(string_split({a}, ''), lambda prev, ca: list_reduce(range(1, length({b}) + 1), "
            f"lambda nr, j: list_append(nr, CASE WHEN ({b})[j] = ca THEN prev[j] + 1 ELSE greatest(prev[j+1], nr[j]) END), [0::BIGINT]), "
            f"list_transform(range(length({b}) + 1), lambda z: 0::BIGINT))[-1] END")


def d_indel(a, b):
    return f"(200.0::DOUBLE * ({d_lcs(a, b)}) / (length({a}) + length({b})))"


VIEWS["name_pairs"] = """
SELECT a, b, min(p_partkey) AS pair_id FROM (SELECT p_partkey, p_name || ' ' || lower(p_type) AS a,
  CASE p_partkey % 3 WHEN 0 THEN lower(p_type) || ' ' || substr(p_name, 3) WHEN 1 THEN p_name || ' of ' || lower(p_brand)
    ELSE substr(p_name, 2, 6) END AS b FROM {part}) x GROUP BY a, b
"""


@query("sim_indel", f"SELECT pair_id, round({d_indel('a', 'b')}, 6) AS ratio FROM name_pairs")
def _(t):
    return t.name_pairs.select("pair_id", F.round(sim.indel(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("sim_composite")
def _(t):
    return t.name_pairs.select("pair_id", F.round(sim.composite_score(F.col("a"), F.col("b")), 6).alias("score"))


@query("sim_cosine_tfidf", """WITH terms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS term FROM documents),
t AS (SELECT * FROM terms WHERE term NOT IN ('the', 'and', 'for', 'with', 'from', 'each', 'only')),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
w AS (SELECT doc_id, term, ln((n + 1)::DOUBLE / (count(*) OVER (PARTITION BY term) + 1)) + 1 AS w FROM t, n),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
d AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND b.doc_id = a.doc_id + 1 GROUP BY 1, 2)
SELECT x.doc_id AS left_id, x.doc_id + 1 AS right_id, round(coalesce(dot / (l.norm * r.norm), 0), 6) AS cosine
FROM documents x LEFT JOIN d ON d.left_id = x.doc_id LEFT JOIN nm l ON l.doc_id = x.doc_id LEFT JOIN nm r ON r.doc_id = x.doc_id + 1""")
def _(t):
    terms = t.documents.select("doc_id", F.explode(tx.content_words(F.col("text"))).alias("term"))
    pairs = t.documents.select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"))
    return pair_cosine(terms, pairs).withColumn("cosine", F.round("cosine", 6))


# ---- JSON, arrays, maps ------------------------------------------------------------------

VIEWS["payload_rows"] = """
SELECT event_id, CASE event_id % 9
  WHEN 0 THEN '{{"attributes": [{{"label": "Size", "value": "2 in", "source_excerpt": "2 in wide", "source_type": "description"}}, {{"label": "Color", "value": "' || event_type || '", "source_excerpt": "x", "source_type": "manufacturer_site"}}]}}'
  WHEN 1 THEN '{{"attributes": []}}'
  WHEN 2 THEN '{{"attributes": [{{"label": "Size", "value": "2 in", "source_excerpt": "2 in", "source_type": "guess"}}]}}'
  WHEN 3 THEN '{{"attributes": [{{"label": "", "value": "2 in", "source_excerpt": "2 in", "source_type": "description"}}]}}'
  WHEN 4 THEN '{{"attributes": [{{"label": "Size", "value": 2, "source_excerpt": "2", "source_type": "description"}}]}}'
  WHEN 5 THEN '{{"attributes": [{{"label": "Size", "value": "2", "source_excerpt": "2", "source_type": "description", "extra": 1}}]}}'
  WHEN 6 THEN '{{"attributes": [{{"label": "Size", "value": "2", "source_type": "description"}}]}}'
  WHEN 7 THEN '{{"attributes": [{{"label": "Size"'
  ELSE props END AS payload
FROM {events}
"""


def _d_one(j):
    return (f"(json_extract(payload, '{j}') IS NULL OR (list_sort(json_keys(payload, '{j}')) = ['label', 'source_excerpt', 'source_type', 'value'] "
            + "".join(f" AND json_type(payload, '{j}.{k}') = 'VARCHAR' AND json_extract_string(payload, '{j}.{k}') <> ''"
                      for k in ("label", "value", "source_excerpt", "source_type"))
            + f" AND json_extract_string(payload, '{j}.source_type') IN ('description', 'manufacturer_site')))")


@query("json_payload", f"""SELECT event_id, coalesce(CASE WHEN json_valid(payload) THEN json_keys(payload) = ['attributes'] AND json_type(payload, '$.attributes') = 'ARRAY'
  AND {_d_one('$.attributes[0]')} AND {_d_one('$.attributes[1]')} ELSE false END, false) AS accepted,
 CASE WHEN event_id % 9 IN (0, 1) THEN 2 - 2 * (event_id % 9) ELSE 0 END AS n FROM payload_rows""")
def _(t):
    checked = payloads.check_candidates(t.payload_rows, "payload")
    return checked.select("event_id", "accepted", F.coalesce(F.size("candidates"), F.lit(0)).cast("bigint").alias("n"))


@query("map_status", """SELECT row_no, 'brand=' || (brand_name <> '')::VARCHAR || ',classpath=' || (classpath <> '')::VARCHAR
 || ',manufacturer=' || (manufacturer_name <> '')::VARCHAR AS status FROM truth""")
def _(t):
    long = (t.truth.select("row_no", *[(F.col(c) != "").alias(n) for n, c in (
        ("manufacturer", "manufacturer_name"), ("brand", "brand_name"), ("classpath", "classpath"))])
        .unpivot(["row_no"], ["manufacturer", "brand", "classpath"], "field", "okay"))
    return payloads.render_status(payloads.status_map(long, ["row_no"]))


@query("arr_leaf", """SELECT commodity_code, segment_name || '>' || family_name || '>' || class_name || '>' || commodity_name AS path,
 commodity_name AS leaf, commodity_name || ' | ' || class_name || ' | ' || family_name || ' | ' || segment_name AS embedding_text FROM taxonomy""")
def _(t):
    path = F.concat_ws(">", "segment_name", "family_name", "class_name", "commodity_name")
    return t.taxonomy.select("commodity_code", path.alias("path"), tx.leaf(path).alias("leaf"),
                             F.concat_ws(" | ", "commodity_name", "class_name", "family_name", "segment_name").alias("embedding_text"))


@query("tpl_tokens", rf"""SELECT row_no, txt AS text, length(txt) AS chars, length(txt) <= 40 AS fits FROM (SELECT row_no,
 {d_collapse("replace(replace(replace('[Brand]  [Commodity], [Size] [Brand] [None]', '[Brand]', brand_name), '[Commodity]', product_name), '[Size]', attribute_value_1)")} AS txt FROM truth) x""")
def _(t):
    values = F.create_map(F.lit("Brand"), F.col("brand_name"), F.lit("Commodity"), F.col("product_name"),
                          F.lit("Size"), F.col("attribute_value_1"))
    text = payloads.fill_template(F.lit("[Brand]  [Commodity], [Size] [Brand] [None]"), values)
    return t.truth.select("row_no", text.alias("text")).select(
        "row_no", "text", F.length("text").cast("bigint").alias("chars"), (F.length("text") <= 40).alias("fits"))


VIEWS["terms"] = """
SELECT canonical, min(p_partkey) AS seq, min(category) AS category,
  CASE min(p_partkey) % 5 WHEN 0 THEN 'FIRST SEEN' WHEN 1 THEN 'FLAGGED' ELSE 'MATCHED' END AS state
FROM (SELECT p_partkey, p_name || ' ' || lower(p_brand) AS canonical, p_type AS category FROM {part}) x GROUP BY canonical
"""
VIEWS["synonyms"] = """
SELECT canonical, 0 AS syn_no, replace(canonical, 'brand#', 'b') AS synonym FROM {terms}
UNION ALL SELECT canonical, 1 AS syn_no, 'x' || CAST(seq AS STRING) || ' kit' AS synonym FROM {terms}
"""
VIEWS["spoken"] = """
SELECT raw, min(p_partkey) AS input_id FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || ' ' || p_brand
  WHEN 1 THEN '  the ' || p_name || ' B' || substr(p_brand, 7) || '!' WHEN 2 THEN 'big X' || CAST(p_partkey AS STRING) || ' Kit here'
  WHEN 3 THEN p_name || ' unknown-thing' ELSE p_type || ' ' || p_name END AS raw FROM {part}) x GROUP BY raw
"""


@query("syn_lookup", """WITH s AS (SELECT *, lower(trim(raw)) AS l FROM spoken),
hits AS (SELECT s.input_id, t.seq, t.canonical, t.state, t.category, -1 AS n FROM s JOIN terms t ON lower(t.canonical) = s.l
 UNION ALL SELECT s.input_id, t.seq, t.canonical, t.state, t.category, y.syn_no FROM s JOIN synonyms y ON contains(s.l, lower(y.synonym)) JOIN terms t USING (canonical)),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY seq, n) = 1)
SELECT s.input_id, coalesce(canonical, array_to_string(list_transform(string_split(trim(raw), ' '), lambda w:
   array_to_string(list_transform(string_split(w, '-'), lambda v: upper(left(v, 1)) || substr(v, 2)), '-')), ' ')) AS canonical,
 coalesce(state, 'FIRST SEEN') AS state, coalesce(category, 'DISCOVERED_CANDIDATE') AS category FROM s LEFT JOIN best USING (input_id)""")
def _(t):
    return payloads.resolve_terms(t.spoken, t.terms, t.synonyms)
