"""Queries over taxonomy search and classification."""

from pyspark.sql import functions as F

from attestry.operators import taxonomy as tax
from attestry.plans.adapters import VIEWS
from attestry.plans.q_text import d_fold
from attestry.plans.q_units import d_indel
from attestry.plans.registry import FRAGMENTS, query
from attestry.sources import reference as ref

FRAGMENTS["q_tok"] = f"SELECT DISTINCT query_id, tok FROM (SELECT query_id, unnest(regexp_extract_all({d_fold('query')}, '[a-z0-9]+')) AS tok FROM queries) x"
FRAGMENTS["c_tok"] = f"SELECT commodity_code, class_code, unnest(regexp_extract_all({d_fold('commodity_name')}, '[a-z0-9]+')) AS tok FROM taxonomy"
FRAGMENTS["tok_ratio"] = f"""SELECT qt, ct, {d_indel('qt', 'ct')} AS ratio FROM (SELECT DISTINCT a.tok AS qt, b.tok AS ct FROM q_tok a JOIN c_tok b
 ON left(a.tok, 4) = left(b.tok, 4) AND length(a.tok) >= 4 AND length(b.tok) >= 4) x"""
FRAGMENTS["lexes"] = """SELECT query_id, commodity_code, class_code, max(ratio) AS lex FROM q_tok JOIN tok_ratio ON q_tok.tok = qt JOIN c_tok ON c_tok.tok = ct GROUP BY 1, 2, 3"""
FRAGMENTS["covers"] = """SELECT query_id, commodity_code, class_code, 100.0::DOUBLE * count(*) FILTER (hit) / count(*) AS cover FROM (
 SELECT q.query_id, c.commodity_code, c.class_code, list_contains(q.marks, left(c.tok, 4)) AS hit FROM
   (SELECT query_id, list(DISTINCT left(tok, 4)) AS marks FROM q_tok WHERE length(tok) >= 3 GROUP BY query_id) q JOIN (SELECT * FROM c_tok WHERE length(tok) >= 3) c ON true) x
 GROUP BY 1, 2, 3 HAVING count(*) FILTER (hit) > 0"""
FRAGMENTS["lab_vec"] = """SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x,
  unnest(range(len(embedding))) AS pos FROM embeddings) a GROUP BY 1, 2) b GROUP BY label"""
FRAGMENTS["cls_vec"] = """SELECT class_code, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS cv FROM class_labels JOIN lab_vec USING (label)"""
FRAGMENTS["q_vec"] = """SELECT query_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS qv FROM queries JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e ON vec_id = query_id"""
FRAGMENTS["cos_all"] = "SELECT query_id, class_code, round(list_dot_product(qv, cv), 6) AS cos FROM q_vec JOIN cls_vec ON true"
FRAGMENTS["branch_class"] = """SELECT query_id, commodity_code, 0.8 * cos + 0.2 * lex / 100 AS score FROM (
 SELECT n.query_id, n.cos, t.commodity_code, coalesce(l.lex, 0) AS lex, row_number() OVER (PARTITION BY n.query_id, n.class_code ORDER BY coalesce(l.lex, 0) DESC, t.commodity_code) AS r
 FROM (SELECT * FROM cos_all QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, class_code) <= 128) n JOIN taxonomy t USING (class_code)
 LEFT JOIN lexes l ON l.query_id = n.query_id AND l.commodity_code = t.commodity_code) x WHERE r <= 10"""
FRAGMENTS["prefix50"] = "SELECT * FROM lexes WHERE lex > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, commodity_code) <= 50"
FRAGMENTS["phrase50"] = "SELECT * FROM covers QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cover DESC, commodity_code) <= 50"
FRAGMENTS["full_pool"] = """SELECT query_id, commodity_code, round(max(score), 8) AS score FROM (
 SELECT * FROM branch_class
 UNION ALL SELECT p.query_id, commodity_code, 0.7 * coalesce(cos, 0) + 0.3 * lex / 100 FROM prefix50 p LEFT JOIN cos_all c USING (query_id, class_code)
 UNION ALL SELECT p.query_id, commodity_code, greatest(0.7 * coalesce(cos, 0) + 0.3 * cover / 100, 0.85 * cover / 100) FROM phrase50 p LEFT JOIN cos_all c USING (query_id, class_code)) u GROUP BY 1, 2"""
FRAGMENTS["top10"] = "SELECT query_id, commodity_code, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, commodity_code) AS rank FROM full_pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, commodity_code) <= 10"


def with_vectors(t):
    from attestry.functions.vectors import l2_normalize

    v = t.embeddings.select(F.col("vec_id").alias("query_id"), l2_normalize(F.col("embedding")).alias("vector"))
    return t.queries.join(v, "query_id", "left")


def class_vectors(t):
    return t.class_labels.join(tax.mean_vectors(t.embeddings, "label"), "label").select("class_code", "vector")


@query("src_taxonomy", """WITH c AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'X' || p_partkey ELSE lpad((p_partkey % 1500)::VARCHAR, 8, '0') END AS code FROM part)
SELECT code, count(*) AS rows, CASE WHEN NOT regexp_full_match(code, '[0-9]{8}') THEN 'invalid' ELSE 'duplicate' END AS problem FROM c
GROUP BY code HAVING NOT regexp_full_match(code, '[0-9]{8}') OR count(*) > 1""")
def _(t):
    code = F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("X"), F.col("p_partkey").cast("string"))).otherwise(
        F.lpad((F.col("p_partkey") % 1500).cast("string"), 8, "0"))
    return ref.taxonomy_problems(t.part.select(F.concat(F.lit(" "), code).alias("code")), "code")


@query("agg_class_groups", """SELECT class_code, min(class_name) AS class_name, min(family_name) AS family_name, min(segment_name) AS segment_name, count(*) AS n,
 string_agg(commodity_code || ':' || commodity_name, '|' ORDER BY commodity_code) AS commodities FROM taxonomy GROUP BY class_code""")
def _(t):
    g = tax.class_groups(t.taxonomy)
    return g.withColumn("n", F.size("commodities").cast("bigint")).withColumn(
        "commodities", F.array_join(F.transform("commodities", lambda c: F.concat(c["commodity_code"], F.lit(":"), c["commodity_name"])), "|"))


@query("join_prefix4", "SELECT query_id, commodity_code, round(lex, 6) AS lex FROM prefix50")
def _(t):
    hits = tax.token_hits(t.queries, t.taxonomy)
    return tax.prefix_best(t.queries, hits, 50).select("query_id", "commodity_code", F.round("lex", 6).alias("lex"))


@query("join_coverage", "SELECT query_id, commodity_code, round(cover, 6) AS cover FROM phrase50")
def _(t):
    return tax.coverage_best(t.queries, t.taxonomy, 50).select("query_id", "commodity_code", F.round("cover", 6).alias("cover"))


@query("join_cosine", """SELECT query_id, class_code, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, class_code) AS rank FROM cos_all
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, class_code) <= 128""")
def _(t):
    return tax.nearest_classes(with_vectors(t), class_vectors(t))


@query("win_pool", "SELECT query_id, commodity_code, score FROM full_pool")
def _(t):
    return tax.candidate_pool(with_vectors(t), t.taxonomy, class_vectors(t))


@query("win_topk", "SELECT query_id, commodity_code, score, rank FROM top10")
def _(t):
    return tax.search(with_vectors(t), t.taxonomy, class_vectors(t)).select("query_id", "commodity_code", "score", "rank")


@query("cls_score", """SELECT p.query_id, commodity_code, round(0.7 * coalesce(cos, 0) + 0.3 * lex / 100, 8) AS prefix_score FROM prefix50 p LEFT JOIN cos_all c USING (query_id, class_code)""")
def _(t):
    q = with_vectors(t)
    best = tax.prefix_best(q, tax.token_hits(q, t.taxonomy), 50)
    return tax.class_scores(best, q, class_vectors(t)).select(
        "query_id", "commodity_code", F.round(0.7 * F.col("cos") + 0.3 * F.col("lex") / 100, 8).alias("prefix_score"))


# ranked candidates with sibling names, one list per order
VIEWS["listings"] = """
SELECT o_orderkey AS query_id, CASE o_orderkey % 5 WHEN 0 THEN '24 in Dish washer steel' WHEN 1 THEN 'commercial dishwasher'
  WHEN 2 THEN 'NSF certified dishwashing machine' WHEN 3 THEN 'built in dishwashing machine' ELSE 'ring bolt' END AS query
FROM {orders}
"""
VIEWS["ranked"] = """
SELECT query_id, commodity_code, commodity_name, classpath, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, commodity_code) AS rank
FROM (SELECT l_orderkey AS query_id, CAST(10000000 + l_partkey AS STRING) AS commodity_code,
  CASE l_partkey % 5 WHEN 0 THEN 'Commercial dish washers' WHEN 1 THEN 'Domestic dish washers' WHEN 2 THEN 'Dish washer parts'
    WHEN 3 THEN 'Dishwashing racks' ELSE 'Mechanical washers' END AS commodity_name,
  CASE WHEN l_partkey % 5 IN (1, 2) THEN 'Appliances>Domestic kitchen>' ELSE 'Food service>Cleaning>' END || CAST(l_partkey AS STRING) AS classpath,
  max(CAST(CAST(floor(l_extendedprice) AS INT) % 1000 AS DOUBLE) / 1000) AS score
  FROM {lineitem} GROUP BY l_orderkey, l_partkey) x
"""


@query("win_margin", """WITH m AS (SELECT query_id, rank, score, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM ranked)
SELECT query_id, score AS top, nxt AS second, round(score - nxt, 6) AS margin FROM m WHERE rank = 1""")
def _(t):
    return tax.margins(t.ranked)


_D_PICK = r"""contains(lower(classpath), 'domestic') AND regexp_matches(commodity_name, '\bdish\s*wash', 'i') AND NOT contains(lower(commodity_name), 'part')"""
FRAGMENTS["overrides"] = rf"""SELECT query_id, arg_min(commodity_code, rank) FILTER ({_D_PICK}) AS commodity_code, arg_min(classpath, rank) FILTER ({_D_PICK}) AS classpath,
  round(greatest(arg_min(score, rank) FILTER ({_D_PICK}), 0.76), 6) AS score FROM ranked JOIN listings USING (query_id)
 WHERE regexp_matches(query, '\bdish\s*wash(?:er|ers|ing machine|ing machines)\b', 'i') AND NOT regexp_matches(query, '\b(commercial|industrial|restaurant|nsf)', 'i')
 GROUP BY query_id HAVING bool_or(contains(lower(commodity_name), 'commercial')) AND count(*) FILTER ({_D_PICK}) > 0"""


@query("cls_override", "SELECT query_id, commodity_code, classpath, score FROM overrides")
def _(t):
    return tax.sibling_override(t.ranked, t.listings)


@query("cls_decide", """WITH a AS (SELECT l.query_id, r1.commodity_code AS c1, r1.classpath AS p1, r1.score AS s1, r2.score AS s2, o.commodity_code AS oc, o.classpath AS op, o.score AS os
 FROM listings l LEFT JOIN ranked r1 ON r1.query_id = l.query_id AND r1.rank = 1 LEFT JOIN ranked r2 ON r2.query_id = l.query_id AND r2.rank = 2 LEFT JOIN overrides o ON o.query_id = l.query_id),
b AS (SELECT *, oc IS NULL AND s2 IS NOT NULL AND round(s1 - s2, 6) <= 0.03 AS close, oc IS NULL AND s2 IS NOT NULL AND s1 < 0.75 AS low FROM a),
c AS (SELECT *, CASE WHEN oc IS NOT NULL THEN oc WHEN NOT close AND NOT low AND s1 >= 0.42 THEN c1 END AS code FROM b)
SELECT query_id, code, CASE WHEN code IS NULL THEN NULL WHEN oc IS NOT NULL THEN op ELSE p1 END AS classpath, CASE WHEN code IS NULL THEN 0.0 WHEN oc IS NOT NULL THEN os ELSE s1 END AS confidence,
 CASE WHEN oc IS NOT NULL THEN 'deterministic_context_rule' WHEN close OR low THEN 'deterministic_review' END AS outcome,
 concat_ws('|', CASE WHEN close THEN 'classification_close_margin' WHEN low THEN 'classification_low_score' END, CASE WHEN code IS NULL THEN 'classification_unresolved' END) AS flags FROM c""")
def _(t):
    return tax.decide(t.ranked, t.listings).withColumn("flags", F.array_join("flags", "|"))


VIEWS["bridge"] = """
SELECT commodity_code, 'Shop>' || family_name || '>' || commodity_name AS shop_path,
  CASE CAST(commodity_code AS INT) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM {taxonomy} WHERE CAST(commodity_code AS INT) % 4 <> 3
"""


@query("join_bridge", """SELECT query_id, t.commodity_code, score, shop_path, confidence FROM top10 t LEFT JOIN bridge b USING (commodity_code) WHERE rank = 1""")
def _(t):
    top = tax.search(with_vectors(t), t.taxonomy, class_vectors(t)).where(F.col("rank") == 1)
    return top.join(t.bridge, "commodity_code", "left").select("query_id", "commodity_code", "score", "shop_path", "confidence")


VIEWS["loose_paths"] = """
SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'Supplies>' || p_type || '>' || substr(p_name, length(p_name) - 4) || '>' || p_name
  WHEN 1 THEN 'Store>' || p_name || 's' ELSE 'Zq>' || substr(p_brand, 6) END AS classpath
FROM {part}
"""


@query("join_category")
def _(t):
    have = t.truth.where("classpath <> ''").select(F.col("classpath").alias("path"))
    return tax.nearest_path(t.loose_paths, have).withColumn("score", F.round("score", 6))


@query("sch_taxonomy", """SELECT commodity_code, segment_name || ' → ' || family_name || ' → ' || class_name || ' → ' || commodity_name AS path FROM taxonomy
WHERE contains(commodity_code, 'gear') OR contains(lower(commodity_name), 'gear') OR contains(lower(class_name), 'gear') OR contains(lower(family_name), 'gear')""")
def _(t):
    from attestry.operators import browse

    return browse.search_taxonomy(tax.class_groups(t.taxonomy), "GEAR")
