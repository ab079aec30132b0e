"""Web evidence, excerpt checks and the extraction gates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.functions import web
from attestry.operators import scanning
from attestry.params import DEFAULTS, Params
from attestry.session import stored


def link_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, url, title) for every search link, redirects unwrapped."""
    found = pages.select(key, F.posexplode(web.links(F.col(html))).alias("pos", "link"))
    return found.select(key, F.col("pos").cast("bigint").alias("pos"),
                        web.unwrap_redirect(F.col("link.href")).alias("url"),
                        tx.collapse(web.unescape(web.strip_tags(F.col("link.title")))).alias("title"))


def name_overlap(manufacturer, url, title):
    """A distinctive word of the name occurs in the host or the title."""
    from attestry import fixed_values as fv

    generic = F.array(*[F.lit(w) for w in fv.GENERIC_NAME_WORDS])
    distinctive = F.array_except(F.split(tx.entity_key(tx.tidy(manufacturer)), " "), generic)
    host = F.split(web.domain(url), "[^a-z0-9]+")
    named = F.split(F.coalesce(tx.entity_key(tx.tidy(title)), F.lit("")), " ")
    return F.coalesce(F.arrays_overlap(F.array_remove(distinctive, ""), F.concat(host, named)), F.lit(False))


def is_blocked(url):
    from attestry import fixed_values as fv

    host = web.domain(url)
    hit = F.lit(False)
    for blocked in fv.BLOCKED_HOSTS:
        hit = hit | (host == blocked) | F.endswith(host, F.lit("." + blocked))
    return F.coalesce(hit, F.lit(False))


def resolve_domains(results: DataFrame, key: str) -> DataFrame:
    """First acceptable host per key from (key, manufacturer, rank, url, title) rows."""
    ok = results.where(web.domain(F.col("url")).isNotNull() & ~is_blocked(F.col("url"))
                       & name_overlap(F.col("manufacturer"), F.col("url"), F.col("title")))
    return ok.groupBy(key).agg(F.min_by(web.domain(F.col("url")), "rank").alias("domain"))


def official_links(results: DataFrame, key: str, owner: str = "owner", k: int = 3) -> DataFrame:
    """First k distinct official URLs of the first query that returned any."""
    from pyspark.sql import Window

    good = results.where(web.is_official(F.col("url"), F.col(owner)))
    first = good.groupBy(key).agg(F.min("query_no").alias("query_no"))
    urls = good.join(first, [key, "query_no"]).groupBy(key, "query_no", "url").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy(key).orderBy("rank", "url")
    return urls.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def evidence_keys(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, evidence_key): the search results of a page as one name key.  A column a step: each is named several times by the next
    one, and Spark evaluates a named column once."""
    text = pages.select(key, web.found_text(F.col(html)).alias("t")).select(key, web.unescape(F.col("t")).alias("t"))
    text = text.select(key, tx.collapse(F.col("t")).alias("t")).select(key, tx.display_name(F.col("t")).alias("t"))
    return text.select(key, tx.display_key(F.col("t")).alias("evidence_key"))


def mentioned_manufacturer(evidence: DataFrame, brands: DataFrame, manufacturers: DataFrame, pairs: DataFrame,
                           key: str, p: Params = DEFAULTS) -> DataFrame:
    """Manufacturer named in an evidence text; one row (key, evidence_key) per key.

    A contained brand that has a paired manufacturer wins (first in name order,
    confidence 0.95).  Otherwise the manufacturer that scores highest, the last by
    name among equals: 0.93 if its key is contained, else its partial ratio, at
    least `p.manufacturer_match`; confidence is at most 0.93.
    """
    owned = brands.join(pairs.withColumnRenamed("brand_key", "key"), "key").select(
        F.col("key").alias("k"), F.col("canonical_name").alias("bname"), F.col("manufacturer").alias("owner"))
    named = manufacturers.select(F.col("key").alias("k"), F.col("canonical_name").alias("mname"))
    evidence = stored(evidence.select(key, "evidence_key"), "evidence")       # read by four steps
    texts = evidence.select(key, "evidence_key", F.length("evidence_key").alias("__n"))
    by_brand = scanning.scan(texts, [key], "evidence_key", owned, "k", scanning.contained).join(owned, F.col("key") == F.col("k"))
    by_brand = by_brand.groupBy(key).agg(F.min_by("owner", F.struct(tx.casefold(F.col("bname")), "bname")).alias("owner"))
    near = scanning.near_mentions(texts, [key, "__n"], "evidence_key", named, "k", 100 * p.manufacturer_match).join(named, F.col("key") == F.col("k"))
    inside = (F.col("score") == 100) & (F.length("k") <= F.col("__n"))
    near = near.groupBy(key).agg(F.max(F.struct(F.when(inside, 0.93).otherwise(F.col("score") / 100).alias("score"), "mname")).alias("best"))
    out = evidence.select(key).join(by_brand, key, "left").join(near, key, "left")
    return out.select(key, F.coalesce("owner", "best.mname").alias("manufacturer"),
                      F.when(F.col("owner").isNotNull(), 0.95).when(F.col("best").isNotNull(), F.least(F.col("best.score"), F.lit(0.93))).alias("confidence"))


# ---- extraction --------------------------------------------------------------------------

def retrieval_gate(items: DataFrame, threshold: float = 0.86) -> DataFrame:
    """Add `use_site`: sparse description, known domain, confident manufacturer."""
    return items.withColumn("use_site", F.coalesce(
        tx.is_sparse(F.col("part_desc")) & web.domain(F.col("domain")).isNotNull()
        & (F.col("manufacturer_confidence") >= threshold), F.lit(False)))


def official_sources(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of gated items with an `official` mark."""
    gated = retrieval_gate(items).where("use_site").select("item_id", "domain")
    return pages.join(gated, "item_id").withColumn("official", web.is_official(F.col("url"), F.col("domain")))


def source_flags(items: DataFrame, marked: DataFrame) -> DataFrame:
    """(item_id, code, kept): foreign pages were refused, or none was left."""
    seen = marked.groupBy("item_id").agg(F.count_if("official").alias("kept"), F.count_if(~F.col("official")).alias("refused"))
    s = retrieval_gate(items).where("use_site").select("item_id").join(seen, "item_id", "left").na.fill(0, ["kept", "refused"])
    codes = F.array_compact(F.array(F.when(F.col("refused") > 0, F.lit("non_official_sources_rejected")),
                                    F.when(F.col("kept") == 0, F.lit("manufacturer_retrieval_no_results"))))
    return s.select("item_id", F.explode(codes).alias("code"), "kept")


def source_blocks(items: DataFrame, marked: DataFrame) -> DataFrame:
    """Description and official page texts as (item_id, source_type, text)."""
    own = items.select("item_id", F.lit("description").alias("source_type"), F.coalesce("part_desc", F.lit("")).alias("text"))
    site = marked.where("official").select("item_id", F.lit("manufacturer_site").alias("source_type"), "text")
    return own.unionByName(site)


def supported_excerpts(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates whose excerpt occurs in a source of the same item and type."""
    s = sources.select("item_id", "source_type", tx.casefold(F.col("text")).alias("__t"))
    c = candidates.withColumn("__e", tx.casefold(F.col("source_excerpt")))
    on = (c["item_id"] == s["item_id"]) & (c["source_type"] == s["source_type"]) & F.contains(s["__t"], c["__e"])
    return c.join(s, on, "left_semi").drop("__e")


def value_in_excerpt(value, excerpt):
    return F.contains(tx.collapse(tx.casefold(excerpt)), tx.collapse(tx.casefold(value)))


def identity_is_labeled(label, value, excerpt, mpn):
    """A Series or Model equal to the part number must be named so in the excerpt."""
    bare = F.trim(value)
    same = tx.casefold(bare) == tx.casefold(F.trim(mpn))
    lab, val = tx.casefold(label), tx.regex_quote(bare)
    before = F.concat(F.lit(r"(?iuU)\b"), lab, F.lit(r"\b\s*[:#-]?\s*"), val, F.lit(r"\b"))
    after = F.concat(F.lit(r"(?iuU)\b"), val, F.lit(r"\b\s*[-,]?\s*\b"), lab, F.lit(r"\b"))
    concerned = F.coalesce(label.isin("Series", "Model") & (F.length(mpn) > 0) & same, F.lit(False))
    return F.when(concerned, F.rlike(excerpt, before) | F.rlike(excerpt, after)).otherwise(True)


def gate(candidates: DataFrame, items: DataFrame, expected: DataFrame, sources: DataFrame) -> DataFrame:
    """Add `reason`: NULL when accepted, else the first failing gate.  A label counts
    as taken from its first passing candidate on, so the earliest passing position
    per label decides duplicates; it is found by a minimum, not by ordering groups."""
    keys = ["item_id", "pos"]
    ok = supported_excerpts(candidates, sources).select(*keys, F.lit(True).alias("__src"))
    wanted = items.select("item_id", "classpath").join(expected, "classpath").select("item_id", "label", F.lit(True).alias("__exp"))
    c = (candidates.join(items.select("item_id", "mpn"), "item_id", "left").join(wanted, ["item_id", "label"], "left")
         .join(ok, keys, "left")
         .withColumn("__val", value_in_excerpt(F.col("value"), F.col("source_excerpt")))
         .withColumn("__idn", identity_is_labeled(F.col("label"), F.col("value"), F.col("source_excerpt"), F.col("mpn"))))
    passing = F.col("__exp").isNotNull() & F.col("__src").isNotNull() & F.col("__val") & F.col("__idn")
    first = c.where(passing).groupBy("item_id", "label").agg(F.min("pos").alias("__first"))
    reason = (F.when(F.col("__exp").isNull() | (F.col("pos") > F.col("__first")), "unexpected_attribute_rejected")
              .when(F.col("__src").isNull(), "source_excerpt_unverified")
              .when(~F.col("__val"), "ungrounded_value_rejected")
              .when(~F.col("__idn"), "product_identity_leakage_rejected"))
    return c.join(first, ["item_id", "label"], "left").select(*candidates.columns, reason.alias("reason"))


def first_per_label(rows: DataFrame, accept, by: list[str], order: str) -> DataFrame:
    """First accepted row per label, by position."""
    cols = [c for c in rows.columns if c not in by]
    return (rows.where(accept).groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("__f")).select(*by, "__f.*"))


def failure_flags(items: DataFrame, failed: DataFrame) -> DataFrame:
    f = failed.select("item_id", F.lit(True).alias("__f")).distinct()
    return items.join(f, "item_id", "left").select("item_id", F.when(F.col("__f"), "extraction_failed").alias("code"))


def phrase_candidates(items: DataFrame, phrases: DataFrame) -> DataFrame:
    """Rule-based candidates: every known (label, value) stated in the description."""
    d = items.select("item_id", tx.casefold(F.col("part_desc")).alias("__d"))
    p = phrases.select("label", "value", tx.casefold(F.col("value")).alias("__v"))
    return (scanning.scan(d, ["item_id"], "__d", p, "__v", scanning.contained).join(p, F.col("key") == F.col("__v"))
            .select("item_id", "label", "value", F.col("value").alias("source_excerpt"), F.lit("description").alias("source_type")))


def run_extractor(items: DataFrame, extract, schema: str) -> DataFrame:
    """Candidates from a user function over Arrow batches (iterator of pandas frames)."""
    return items.mapInPandas(extract, schema)
