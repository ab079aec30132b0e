"""Queries over cleaning, keys, web text and record sources."""

from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions import text as tx
from attestry.functions import web
from attestry.operators import cleaning
from attestry.params import DEFAULTS
from attestry.plans.registry import FRAGMENTS, query
from attestry.session import scratch_path
from attestry.sources import catalog as src

FIELDS = cleaning.FIELDS


# ---- check-side expressions ----------------------------------------------------------

def d_fold(x):
    return f"replace(lower({x}), 'ß', 'ss')"


def d_clean(x):
    return (f"nullif(trim(regexp_replace(regexp_replace(translate(replace({x}, 'ﬁ', 'fi'), '‐‑‒–—−\u00a0', '------ '),"
            r" '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')), '')")


PLACEHOLDERS = ", ".join(f"'{p}'" for p in fv.PLACEHOLDERS)


def d_placeholder(x):
    return f"coalesce(trim({d_fold(x)}, ' -_.,:;') IN ({PLACEHOLDERS}), true)"


def d_collapse(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def d_display(x):
    return rf"trim(regexp_replace({x}, '\s*\([^()]+\)\s*$', ''))"


SUFFIXES = "|".join(fv.LEGAL_SUFFIXES)


def d_key(x):
    base = f"trim(regexp_replace(replace({d_fold(d_display(x))}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    return f"trim(regexp_replace({base}, '(?:(?:^| )(?:{SUFFIXES}))+$', ''))"


def d_cmp_key(x):
    return f"trim(regexp_replace({d_fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def d_domain(x):
    full = f"CASE WHEN contains({x}, '://') THEN {x} ELSE 'https://' || {x} END"
    host = rf"rtrim(lower(regexp_replace(regexp_replace(regexp_extract({full}, '^[^:/?#]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')), '.')"
    return rf"nullif(regexp_replace({host}, '^www\.', ''), '')"


def d_unescape(x):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"),
                 ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


FRAGMENTS["cleaned0"] = ("SELECT row_no, " + ", ".join(f"{f} AS raw_{f}, {d_clean(f)} AS {f}" for f in FIELDS)
                         + " FROM catalog")
FRAGMENTS["cleaned"] = ("SELECT row_no, " + ", ".join(
    f"raw_{f}, CASE WHEN NOT {d_placeholder(f)} THEN {f} END AS {f}" for f in FIELDS) + ", "
    + "list_filter([" + ", ".join(f"CASE WHEN raw_{f} IS NOT NULL AND {d_placeholder(f)} THEN '{f}' END"
                                  for f in FIELDS) + "], lambda v: v IS NOT NULL) AS nullified_fields FROM cleaned0")


# ---- cleaning --------------------------------------------------------------------------

@query("cln_text", f"""SELECT doc_id, {d_clean("t")} AS cleaned FROM (SELECT doc_id,
  CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN '  ' || replace(text, ' ', '  ') WHEN 2 THEN replace(text, '-', '—') || chr(7)
    WHEN 3 THEN replace(text, ' ', chr(160)) WHEN 4 THEN 'ﬁ' || text || chr(127) ELSE ' ' || chr(31) || ' ' END AS t FROM documents) x""")
def _(t):
    k, s = F.col("doc_id") % 6, F.col("text")
    dirty = (F.when(k == 0, s).when(k == 1, F.concat(F.lit("  "), F.replace(s, F.lit(" "), F.lit("  "))))
             .when(k == 2, F.concat(F.replace(s, F.lit("-"), F.lit("—")), F.lit("\x07")))
             .when(k == 3, F.replace(s, F.lit(" "), F.lit("\u00a0")))
             .when(k == 4, F.concat(F.lit("ﬁ"), s, F.lit("\x7f"))).otherwise(F.lit(" \x1f ")))
    return t.documents.select("doc_id", tx.clean_text(dirty).alias("cleaned"))


@query("cln_placeholder", f"""SELECT row_no, {", ".join(f"{d_placeholder(f)} AS {f}" for f in FIELDS)} FROM cleaned0""")
def _(t):
    return t.catalog.select("row_no", *[tx.is_placeholder(tx.clean_text(F.col(f))).alias(f) for f in FIELDS])


@query("cln_optional", f"""SELECT row_no, {", ".join(FIELDS)} FROM cleaned""")
def _(t):
    return t.catalog.select("row_no", *[tx.clean_optional(F.col(f)).alias(f) for f in FIELDS])


@query("cln_stage", f"""SELECT row_no, {", ".join(FIELDS)}, array_to_string(nullified_fields, '|') AS nullified FROM cleaned""")
def _(t):
    out = cleaning.clean_catalog(t.catalog)
    return out.select("row_no", *FIELDS, F.array_join("nullified_fields", "|").alias("nullified"))


@query("cln_profile", "SELECT field, count(*) AS nulled FROM (SELECT unnest(nullified_fields) AS field FROM cleaned) GROUP BY field")
def _(t):
    return cleaning.placeholder_profile(cleaning.clean_catalog(t.catalog))


@query("cln_placeholder_cols", "WITH head AS (SELECT * FROM {c} ORDER BY row_no LIMIT 20) ".replace("{c}", "cleaned0")
       .replace("WITH head AS (", "SELECT field, sum(flag)::BIGINT AS placeholders, count(*) AS rows, sum(flag) / count(*) > 0.6 AS mostly_placeholder FROM (")
       .replace("LIMIT 20) ", "LIMIT 20) head, ") + "LATERAL (VALUES " + ", ".join(
           f"('{f}', CAST({d_placeholder('head.' + f)} AS INT))" for f in FIELDS) + ") v(field, flag) GROUP BY field")
def _(t):
    return cleaning.mostly_placeholder_columns(t.catalog, "row_no")


# ---- keys ------------------------------------------------------------------------------

FRAGMENTS["spelt"] = f"SELECT row_no, value, {d_clean('value')} AS c FROM spellings"


@query("ent_display", f"SELECT row_no, {d_display('c')} AS display FROM spelt")
def _(t):
    return t.spellings.select("row_no", tx.display_name(tx.clean_text(F.col("value"))).alias("display"))


@query("ent_key", f"SELECT row_no, {d_key('c')} AS key FROM spelt")
def _(t):
    return t.spellings.select("row_no", tx.entity_key(tx.clean_text(F.col("value"))).alias("key"))


@query("ent_mpn_key", f"SELECT row_no, regexp_replace({d_fold('mfg_part_num')}, '[^a-z0-9]+', '', 'g') AS part_key FROM catalog")
def _(t):
    return t.catalog.select("row_no", tx.part_key(F.col("mfg_part_num")).alias("part_key"))


@query("cls_query", r"""
SELECT row_no, trim(regexp_replace(CASE WHEN regexp_matches(q5, '\b\d{2}(?:\s*in\b|").*\bfan\b', 'i') THEN q5 || ' ceiling fan' ELSE q5 END, '\s+', ' ', 'g'), ' -_,') AS query
FROM (SELECT row_no, CASE WHEN regexp_matches(q4, '\bSJ(?:E|EO|T|TO|TW|EOW|EW)A?\b', 'i') THEN q4 || ' portable electrical cord' ELSE q4 END AS q5
FROM (SELECT row_no, CASE WHEN regexp_matches(q3, '\bpatio\s+door\b', 'i') AND regexp_matches(q3, '\blow-?e\b', 'i') THEN q3 || ' glass door' ELSE q3 END AS q4
FROM (SELECT row_no, regexp_replace(regexp_replace(regexp_replace(q1, '\bdisplay\s+only\b', ' ', 'gi'),
   '\bcut\s*(?:n|and)\s*grind\s+disc\b', 'abrasive cutting grinding disc', 'gi'), '\bpatio\s+dr\b', 'patio door', 'gi') AS q3
FROM (SELECT row_no, CASE WHEN mfg_part_num IS NULL THEN coalesce(part_desc, '')
   WHEN strpos(lower(coalesce(part_desc, '')), lower(mfg_part_num)) > 0
     THEN left(part_desc, strpos(lower(part_desc), lower(mfg_part_num)) - 1) || ' ' || substr(part_desc, strpos(lower(part_desc), lower(mfg_part_num)) + length(mfg_part_num))
   ELSE coalesce(part_desc, '') END AS q1 FROM cleaned) a) b) c) d
""")
def _(t):
    c = t.catalog.select("row_no", tx.clean_optional(F.col("part_desc")).alias("d"),
                         tx.clean_optional(F.col("mfg_part_num")).alias("m"))
    return c.select("row_no", tx.classification_query(F.col("d"), F.col("m")).alias("query"))


@query("ext_sparse", rf"""SELECT doc_id, length(text) < 80 OR (CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split({d_collapse('text')}, ' ')) END) < 8 AS sparse
FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.is_sparse(F.col("text")).alias("sparse"))


@query("cmp_text", rf"""SELECT row_no, {d_collapse(d_fold("translate(b, '®™', '')"))} AS plain, {d_collapse(d_fold('b'))} AS marked
FROM (SELECT row_no, '  ' || brand_name || '™  Straße ' || product_name AS b FROM truth) x""")
def _(t):
    b = F.concat(F.lit("  "), F.col("brand_name"), F.lit("™  Straße "), F.col("product_name"))
    return t.truth.select("row_no", tx.comparison_text(b, True).alias("plain"), tx.comparison_text(b).alias("marked"))


@query("cmp_key", f"SELECT doc_id, {d_cmp_key('text')} AS key FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.comparison_key(F.col("text")).alias("key"))


@query("tok_words", rf"""SELECT doc_id, array_to_string(list_filter(w, lambda x: length(x) >= 4), ' ') AS long_words,
 array_to_string(list_filter(w, lambda x: length(x) >= 3), ' ') AS mid_words,
 array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}'),
    lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'each', 'only')))), ' ') AS content
FROM (SELECT doc_id, text, regexp_extract_all({d_fold('text')}, '[a-z0-9]+') AS w FROM documents) x""")
def _(t):
    d = F.col("text")
    return t.documents.select("doc_id", F.array_join(tx.words(d, 4), " ").alias("long_words"),
                              F.array_join(tx.words(d, 3), " ").alias("mid_words"),
                              F.array_join(F.array_sort(tx.content_words(d)), " ").alias("content"))


# ---- web text --------------------------------------------------------------------------

@query("web_domain", f"SELECT page_id, {d_domain('url')} AS domain FROM pages")
def _(t):
    return t.pages.select("page_id", web.domain(F.col("url")).alias("domain"))


@query("web_official", f"""SELECT page_id, {d_domain('url')} = o OR ends_with({d_domain('url')}, '.' || o) AS official
FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'ample.com' ELSE 'example.net' END AS o FROM pages) x""")
def _(t):
    owner = F.when(F.col("page_id") % 3 == 0, "example.com").when(F.col("page_id") % 3 == 1, "ample.com").otherwise(
        "https://www.example.net/home")
    return t.pages.select("page_id", web.is_official(F.col("url"), owner).alias("official"))


@query("web_strip_html", rf"""SELECT page_id, w AS text, left(w, {DEFAULTS.page_text_limit}) AS shown, length(w) AS n_chars, length(w) > {DEFAULTS.page_text_limit} AS truncated
FROM (SELECT page_id, {d_collapse(d_unescape("regexp_replace(html, '<[^>]+>', ' ', 'g')"))} AS w FROM pages) x""")
def _(t):
    """Whole texts; what a job with the usual limit shows of them is a column of its own."""
    pages = t.pages.select("page_id", web.page_text(F.col("html"), None).alias("p"))
    return pages.select("page_id", "p.text", F.left("p.text", F.lit(DEFAULTS.page_text_limit)).alias("shown"), "p.n_chars",
                        (F.col("p.n_chars") > DEFAULTS.page_text_limit).alias("truncated"))


FRAGMENTS["page_links"] = rf"""SELECT page_id, pos, CASE WHEN contains(href, 'uddg=')
   THEN url_decode(regexp_extract(replace(href, '&amp;', '&'), '[?&]uddg=([^&#]+)', 1)) ELSE {d_unescape('href')} END AS url,
 {d_collapse(d_unescape("regexp_replace(title, '<[^>]+>', ' ', 'g')"))} AS title
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?is)class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 2)) AS title,
  unnest(range(len(regexp_extract_all(html, '(?is)class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>')))) AS pos FROM pages_linked) x"""


@query("web_links", "SELECT page_id, pos, url, title FROM page_links")
def _(t):
    return page_links(t)


def page_links(t):
    from attestry.operators.evidence import link_rows

    return link_rows(t.pages_linked, "page_id")


# ---- sources ---------------------------------------------------------------------------

@query("src_catalog_csv", f"""SELECT row_no AS source_row_number, {", ".join(f"coalesce({f}, '') AS {f}" for f in FIELDS)} FROM catalog""")
def _(t):
    path = scratch_path(t.spark, "catalog-csv")
    # files of unequal size, the largest last: their rows must still be numbered in file order
    share = F.sqrt(F.col("row_no") / t.catalog.count())
    wide = t.catalog.repartitionByRange(5, F.floor(share * 5)).sortWithinPartitions("row_no")
    src.write_csv(wide.select(*[F.col(c.lower()).alias(c) for c in fv.CATALOG_COLUMNS]), path)
    return src.read_catalog_csv(t.spark, path)


@query("src_row_map", f"SELECT row_no AS source_row_number, {', '.join(FIELDS)} FROM catalog")
def _(t):
    named = t.catalog.select("row_no", *[F.col(c.lower()).alias(c) for c in fv.CATALOG_COLUMNS])
    return src.input_rows(named, "row_no")


@query("src_row_count", """SELECT count(*) FILTER (trim(text) <> '' OR lang <> '') AS data_rows, count(*) AS all_rows,
 count(*) FILTER (trim(text) <> '' OR lang <> '') = 200 AS as_expected
FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN '   ' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang FROM documents) x""")
def _(t):
    d = t.documents.select(F.when(F.col("doc_id") % 9 == 0, "   ").otherwise(F.col("text")).alias("text"),
                           F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"))
    return src.row_count(d, ["text", "lang"], expected=200)


_BATCH = ", ".join(f"nullif({f}, '') AS {f}" for f in FIELDS)


@query("src_batch_csv", f"""SELECT row_no, {_BATCH} FROM catalog WHERE row_no % 10 <> 0""")
def _(t):
    blank = F.col("row_no") % 10 == 0
    wide = t.catalog.select(F.col("row_no"), *[F.when(blank, F.lit("  ")).otherwise(F.col(c.lower())).alias(c)
                                               for c in fv.CATALOG_COLUMNS])
    path = scratch_path(t.spark, "batch-csv")
    src.write_csv(wide.withColumn("row_no", F.when(~blank, F.col("row_no").cast("string"))), path, quote_all=True)
    rows = src.read_batch_csv(t.spark, path)
    return rows.select(F.col("row_no").cast("bigint").alias("row_no"), *[F.nullif(c, F.lit("")).alias(c.lower()) for c in fv.CATALOG_COLUMNS])
