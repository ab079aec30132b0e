"""DuckDB SQL for the queries that SQL can express."""

from attestry.llm.mixing import BITS, BUCKETS, MixParams
from attestry.llm.pii import AGAINST, KINDS, NEAR, PATTERNS, SCORES, PiiParams

# the same patterns without look-behinds and possessive quantifiers, which only save retries
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": PATTERNS["iban"],
}
_VALID = {
    "email": "true",
    "ip": r"list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(x, 3) AS INTEGER) <= 255))",
    "card": "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INTEGER) "
            "ELSE (2 * CAST(substr(reverse(d), i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(reverse(d), i, 1) AS INTEGER)) % 10 END)) % 10 = 0",
    "phone": "length(d) BETWEEN 9 AND 15",
    # one digit at a time: letters were written as two digits before
    "iban": "list_reduce(list_transform(string_split(n, ''), lambda x: CAST(x AS INTEGER)), lambda r, x: (r * 10 + x) % 97) = 1 "
            "AND NOT regexp_matches(CASE WHEN a > 0 THEN substr(t, a, 1) ELSE '' END || ' ' || substr(t, a + length(v) + 1, 1), '[A-Za-z0-9]')",
}


def _score(kind: str) -> str:
    """Thousandths, from the lower-cased text before a match."""
    p, milli = PiiParams(), lambda x: round(1000 * x)
    before = f"lower(substr(t, greatest(1, a + 1 - {p.window}), least({p.window}, a)))"
    # without look-ahead: "order to" is taken out first
    free = f"regexp_replace({before}, '\\borders?[\\s\\x0B]+to\\b', ' ', 'g')"
    against = AGAINST[kind].replace(r"(?!\s+to\b)", "")
    down = "0" if AGAINST[kind] == "(?!)" else f"CASE WHEN regexp_matches({free}, '{against}') THEN {milli(p.lowered)} ELSE 0 END"
    return f"greatest(0, least(1000, {milli(SCORES[kind])} + CASE WHEN regexp_matches({before}, '{NEAR[kind]}') THEN {milli(p.raised)} ELSE 0 END - {down}))"


def _pii() -> str:
    letters = "replace(v, ' ', '')"
    number = f"substr({letters}, 5) || left({letters}, 4)"
    for i in range(26):
        number = f"replace({number}, '{chr(65 + i)}', '{10 + i}')"
    parts = []
    for rank, kind in enumerate(KINDS):
        parts.append(f"""
  SELECT doc_id, {rank} AS r, '{kind}' AS kind, a, a + length(v) AS b, {_score(kind)} AS s FROM (
    SELECT doc_id, t, v, a, regexp_replace(v, '[^0-9]', '', 'g') AS d, {number if kind == 'iban' else "''"} AS n FROM (
      SELECT doc_id, t, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM (SELECT doc_id, t, regexp_extract_all(t, '{_PLAIN[kind]}') AS m, string_split_regex(t, '{_PLAIN[kind]}') AS g,
                   unnest(range(1, len(regexp_extract_all(t, '{_PLAIN[kind]}')) + 1)) AS i FROM docs WHERE regexp_matches(t, '{_PLAIN[kind]}')) x) y) z
  WHERE {_VALID[kind]}""")
    lists = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
told AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS[:4])},
  {lists} FILTER (WHERE kind <> 'iban') AS base, {lists} AS spans, count(*) AS n_spans,
  string_agg(s, ',' ORDER BY a, r) AS scores FROM found GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores_milli
FROM docs d LEFT JOIN told f ON f.doc_id = d.doc_id"""


def _mixing() -> str:
    p = MixParams()
    order = f"(ORDER BY {p.max_copies} * size_all / weight, source NULLS LAST"
    rounds, state = [], "start"
    for j in range(p.rounds):
        last = j == p.rounds - 1
        limit = "4611686018427387904" if j == 0 else f"floor(greatest(0.0, s.words_left) * {2 if last else 1})"
        rounds.append(f"""
run{j} AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size{" / 2.0" if last else ""} AS after
  FROM {state} s WHERE sampled = 0 AND size <= {limit}),
took{j} AS (SELECT source, max(place) AS last, sum(size) AS used FROM run{j} WHERE after <= words_left GROUP BY source),
state{j} AS (SELECT s.* EXCLUDE (words_left, sampled), s.words_left - coalesce(t.used, 0) AS words_left,
  s.sampled + CASE WHEN s.sampled = 0 AND s.place <= t.last AND s.size <= {limit} THEN 1 ELSE 0 END AS sampled
  FROM {state} s LEFT JOIN took{j} t ON t.source IS NOT DISTINCT FROM s.source)""")
        state = f"state{j}"
    return f"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS size_all FROM sized GROUP BY source),
weighted AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {p.cycle} + 1 AS DOUBLE) AS weight, sum(size_all) OVER () AS total FROM sources),
levels AS (SELECT *, {p.max_copies} * size_all AS cap, row_number() OVER {order}) AS place_at,
  (total - coalesce(sum({p.max_copies} * size_all) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
   / (sum(weight) OVER () - coalesce(sum(weight) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM weighted),
targets AS (SELECT source, size_all, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target, cap
  FROM levels LEFT JOIN (SELECT level FROM levels WHERE level * weight <= cap ORDER BY place_at LIMIT 1) f ON true),
times AS (SELECT *, CASE WHEN size_all > 0 THEN least(cap, target / greatest(size_all, 1) * greatest(size_all, 1)) / size_all ELSE 0.0 END AS times FROM targets),
shares AS (SELECT *, floor(times) AS copies, times - floor(times) AS pi, target - floor(times) * size_all AS words_left,
  (times - floor(times)) * size_all / greatest(1, size_all) AS pi_source FROM times),
drawn AS (SELECT z.doc_id, z.source, z.size, s.* EXCLUDE (source),
  (CAST('0x' || substr(md5('{p.seed}:' || coalesce(CAST(z.doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) + 0.5) / {float(2 ** BITS)!r} AS u
  FROM sized z JOIN shares s ON z.source IS NOT DISTINCT FROM s.source),
odds AS (SELECT *, CASE WHEN pi > 0 AND size > 0 THEN u / (1.0 - u) / (pi / (1.0 - pi)) END AS odds, pi_source / (1.0 - pi_source) AS even FROM drawn),
start AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(odds * even / (1.0 + odds * even) * {BUCKETS}), odds, doc_id, size) AS place,
  0 AS sampled FROM odds WHERE odds IS NOT NULL),{','.join(rounds)}
SELECT d.doc_id, d.size, d.size_all AS source_size, d.target, CAST(CASE WHEN d.size > 0 THEN d.copies + coalesce(r.sampled, 0) ELSE 0 END * d.size AS BIGINT) AS taken
FROM drawn d LEFT JOIN {state} r ON r.doc_id = d.doc_id"""


_LATTICE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
usable AS MATERIALIZED (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id"""

_WARC = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest"""

_TOPK = """
WITH q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _tree(name: str, levels: int) -> str:
    """Levels over `{name}0` (tree, size, k, d), siblings at each, and `{name}c0` (tree, k, f, proof, ..) folded level by level."""
    parts = []
    for i in range(levels):
        parts.append(f"""
{name}p{i} AS MATERIALIZED (SELECT tree, size, k, d, coalesce(lag(d, 2) OVER w, '') || coalesce(lag(d, 1) OVER w, '') AS before,
  coalesce(lead(d, 1) OVER w, '') || coalesce(lead(d, 2) OVER w, '') AS after FROM {name}{i} WINDOW w AS (PARTITION BY tree, k // 3 ORDER BY k)),
{name}{i + 1} AS MATERIALIZED (SELECT tree, (size + 2) // 3 AS size, k // 3 AS k, CASE WHEN size = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY k)) END AS d
  FROM {name}{i} GROUP BY tree, size, k // 3),
{name}c{i + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (k, f, proof), c.k // 3 AS k, CASE WHEN p.size = 1 THEN c.f ELSE sha256(p.before || c.f || p.after) END AS f,
  CASE WHEN p.size = 1 THEN c.proof ELSE c.proof || p.before || p.after END AS proof FROM {name}c{i} c JOIN {name}p{i} p ON p.tree = c.tree AND p.k = c.k)""")
    return ",".join(parts)


def _merkle(levels: int = 15) -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    digits = "list_transform(range(1, length(i) + 1), lambda n: CAST(ascii(substr(i, n, 1)) AS BIGINT))"
    return f"""
WITH docs AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS i FROM documents),
marked AS (SELECT *, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: {bits}) & 1 = 1 AS even FROM docs),
leaves AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN even THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS seen FROM marked),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM leaves) s),
placed AS MATERIALIZED (SELECT l.*, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY s.tree) AS size
  FROM leaves l JOIN sources s ON s.source IS NOT DISTINCT FROM l.source),
a0 AS (SELECT tree, size, k, leaf AS d FROM placed), ac0 AS (SELECT doc_id, leaf, tree, k, seen AS f, '' AS proof FROM placed),{_tree('a', levels)},
b0 AS (SELECT 0 AS tree, (SELECT count(*) FROM sources) AS size, tree AS k, d FROM a{levels}),
bc0 AS (SELECT c.doc_id, c.leaf, a.d AS subroot, 0 AS tree, c.tree AS k, c.f, c.proof FROM ac{levels} c JOIN a{levels} a ON a.tree = c.tree),{_tree('b', levels)}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM bc{levels} c JOIN b{levels} r ON r.tree = c.tree"""


ORACLES: dict[str, str] = {"op1_pii": _pii(), "op2_mixing": _mixing(), "op7_lattice": _LATTICE, "op8_warc": _WARC, "op9_topk": _TOPK, "op13_merkle": _merkle()}
