"""Entity vocabularies and brand/manufacturer resolution.

A vocabulary is a table: one row per entry (canonical_name, key, frequency,
aliases).  Spellings are clustered by leaders: in rank order (most frequent
first), a key joins the best earlier leader at the cluster ratio or becomes one.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import similarity as sim
from attestry.functions import text as tx
from attestry.operators import scanning
from attestry.operators.namesearch import nearest_names
from attestry.params import DEFAULTS, Params
from attestry.session import cut_lineage

SEARCHED = 256      # names that a task searches for

BRAND_FIELDS = ("e1_brand", "unilog_brand", "dib_brand")


# ---- observations ------------------------------------------------------------------

def observations(catalog: DataFrame, truth: DataFrame | None = None, cleaned: bool = False) -> DataFrame:
    """Long (kind, source, value) rows of every usable spelling in both files."""
    names = (*BRAND_FIELDS, "part_manuf")
    cat = catalog.select(*names) if cleaned else catalog.select(*[tx.clean_optional(F.col(c)).alias(c) for c in names])
    rows = cat.unpivot([], [*BRAND_FIELDS, "part_manuf"], "field", "value").select(
        F.when(F.col("field") == "part_manuf", "manufacturer").otherwise("brand").alias("kind"),
        F.lit("catalog").alias("source"), "value")
    if truth is not None:
        tru = truth.select(tx.clean_optional(F.col("manufacturer_name")).alias("manufacturer"),
                           tx.clean_optional(F.col("brand_name")).alias("brand"))
        rows = rows.unionByName(tru.unpivot([], ["manufacturer", "brand"], "kind", "value").select(
            "kind", F.lit("truth").alias("source"), "value"))
    return rows.where(F.col("value").isNotNull())


def written_observations(catalog: DataFrame, truth: DataFrame) -> DataFrame:
    """Long (kind, value) rows of both files as they are written, for `cleaned_spellings`."""
    rows = lambda df, **kinds: df.select(F.inline(F.array(*[F.struct(F.lit(k.split("_")[0]).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])))
    both = rows(catalog, **{f"brand_{c}": c for c in BRAND_FIELDS}, manufacturer="part_manuf").unionByName(rows(truth, brand="brand_name", manufacturer="manufacturer_name"))
    return both.where(F.col("value").isNotNull())


def cleaned_spellings(raw: DataFrame, by: list[str] = []) -> DataFrame:
    """(by, value, n) of raw spellings (by, value): rows are counted as they are written, then each distinct spelling is cleaned once.
    Written between, or Spark would move the filter, and the cleaning with it, back to the rows."""
    written = cut_lineage(raw.groupBy(*by, "value").agg(F.count("*").alias("n")))
    return written.select(*by, tx.clean_optional(F.col("value")).alias("value"), "n").where(F.col("value").isNotNull())


def count_spellings(obs: DataFrame, by: list[str] = ["kind"]) -> DataFrame:
    """Rows per spelling, or the sum of `n` where the observations are counted already."""
    counted = obs.groupBy(*by, "value").agg((F.sum("n") if "n" in obs.columns else F.count("*")).alias("n"))
    return counted.withColumn("key", tx.entity_key(F.col("value"))).where(F.col("key") != "")


def spelling_rank(count: Column, value: Column) -> Column:
    return F.struct((-count).alias("neg"), tx.casefold(value).alias("folded"), value.alias("value"))


# ---- near-duplicate keys -----------------------------------------------------------

_SHORT = 36  # shorter partners below this length allow at most two edits at ratio 96


def _deletions(level: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1))))))


def near_keys(keys: DataFrame, threshold: float = DEFAULTS.cluster_ratio) -> DataFrame:
    """All pairs (a, b, score), a < b, of distinct keys with ratio >= threshold.

    Ratio r means at most (1 - r) * (len a + len b) single-character deletions in
    total make both equal.  Short keys meet on a shared deletion variant, and the
    fewest deletions give the exact ratio.  Long keys meet on one of the pieces of
    the shorter key that must survive unchanged, and are then scored.
    """
    slack = 1.0 - threshold / 100.0
    if slack > 0.04 + 1e-9:
        raise ValueError("near_keys enumerates up to two deletions, which covers ratios of 96 and above")
    k = keys.select("key").distinct().withColumn("len", F.length("key"))
    stretch = (1 + slack) / (1 - slack)

    def budget(shorter: Column) -> Column:
        return F.floor(F.lit(slack) * (shorter + F.floor(shorter * F.lit(stretch) + F.lit(1e-9))) + F.lit(1e-9)).cast("int")

    # short partners
    s = k.where(F.col("len") <= F.lit(int(_SHORT * stretch) + 1)).withColumn("tau", F.least(budget(F.col("len")), F.lit(2)))
    one = F.when(F.col("tau") >= 1, _deletions(F.array("key"))).otherwise(F.array().cast("array<string>"))
    s = s.withColumn("one", one)
    two = F.when(F.col("tau") >= 2, _deletions(F.col("one"))).otherwise(F.array().cast("array<string>"))
    variants = (s.where("tau >= 1").select("key", "len", F.explode(F.concat(
        F.array(F.struct(F.col("key").alias("v"), F.lit(0).alias("d"))),
        F.transform("one", lambda v: F.struct(v.alias("v"), F.lit(1).alias("d"))),
        F.transform(two, lambda v: F.struct(v.alias("v"), F.lit(2).alias("d"))))).alias("__x"))
        .select("key", "len", "__x.v", "__x.d"))
    a, b = variants.alias("a"), variants.alias("b")
    edits = F.col("a.d") + F.col("b.d")
    total = F.col("a.len") + F.col("b.len")
    close = (a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.key") < F.col("b.key"))
                    & (edits <= F.lit(slack) * total + F.lit(1e-9)))
             .where(F.least("a.len", "b.len") < _SHORT)
             .groupBy(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
             .agg(F.min(F.lit(100.0) * (total - edits) / total).alias("score")))

    # long partners
    long = k.where(F.col("len") >= _SHORT)

    def pieces(length: Column, tau: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), tau), lambda i: F.struct(
            i.alias("i"), F.floor(i * length / (tau + 1)).cast("int").alias("start"),
            (F.floor((i + 1) * length / (tau + 1)) - F.floor(i * length / (tau + 1))).cast("int").alias("n")))

    base = long.withColumn("tau", budget(F.col("len")))
    segments = (base.select("key", F.col("len").alias("short_len"), F.explode(pieces(F.col("len"), F.col("tau"))).alias("p"))
                .select(F.col("key").alias("short_key"), "short_len", F.col("p.i").alias("i"),
                        F.substr("key", F.col("p.start") + 1, F.col("p.n")).alias("piece")))
    probes = (long.select("key", "len", F.explode(F.sequence(
        F.greatest(F.ceil(F.col("len") / F.lit(stretch) - F.lit(1e-9)).cast("int"), F.lit(_SHORT)), F.col("len"))).alias("short_len"))
        .withColumn("tau", budget(F.col("short_len")))
        .withColumn("p", F.explode(pieces(F.col("short_len"), F.col("tau"))))
        .withColumn("shift", F.explode(F.sequence(-F.col("tau"), F.col("tau"))))
        .where((F.col("p.start") + F.col("shift") >= 0) & (F.col("p.start") + F.col("shift") + F.col("p.n") <= F.col("len")))
        .select("key", "len", "short_len", F.col("p.i").alias("i"),
                F.substr("key", F.col("p.start") + F.col("shift") + 1, F.col("p.n")).alias("piece")))
    limit = F.floor(F.lit(slack) * (F.col("short_len") + F.col("len")) + F.lit(1e-9)).cast("int")
    met = (segments.join(probes, ["short_len", "i", "piece"]).where(F.col("short_key") != F.col("key"))
           .where(F.levenshtein("short_key", "key") <= limit)
           .select(F.least("short_key", "key").alias("a"), F.greatest("short_key", "key").alias("b")).distinct())
    scored = met.withColumn("score", sim.ratio_score("a", "b")).where(F.col("score") >= threshold - 1e-9)
    return close.unionByName(scored)


def leader_members(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys that are not leaders, from (key, rank) rows and near pairs.  Leaders are
    the lexicographically first maximal independent set, found in rounds."""
    r = ranked.select("key", "rank")
    ra, rb = r.select(F.col("key").alias("a"), F.col("rank").alias("ra")), r.select(F.col("key").alias("b"), F.col("rank").alias("rb"))
    first = F.col("ra") < F.col("rb")
    edges = cut_lineage(pairs.join(ra, "a").join(rb, "b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("later")))
    rounds = [edges.select(F.col("later").alias("key")).limit(0)]
    while not edges.isEmpty():
        leaders = edges.select("earlier").distinct().join(edges.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        members = cut_lineage(edges.join(leaders, "earlier").select(F.col("later").alias("key")).distinct())
        rounds.append(members)
        edges = cut_lineage(edges.join(members.select(F.col("key").alias("later")), "later", "left_anti")
                            .join(members.select(F.col("key").alias("earlier")), "earlier", "left_anti"))
    return reduce(DataFrame.unionByName, rounds)


def assign_leaders(spellings: DataFrame, threshold: float = DEFAULTS.cluster_ratio) -> DataFrame:
    """Add `leader` (the cluster key) to counted spellings (value, n, key), which are written once for the steps that read them."""
    spellings = cut_lineage(spellings)
    sp = spellings.withColumn("rank", spelling_rank(F.col("n"), F.col("value")))
    ranked = sp.groupBy("key").agg(F.min("rank").alias("rank"))
    pairs = cut_lineage(near_keys(ranked, threshold))
    members = leader_members(ranked, pairs)
    leaders = ranked.join(members, "key", "left_anti").select(F.col("key").alias("leader"), F.col("rank").alias("leader_rank"))
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("leader"), "score").unionByName(
        pairs.select(F.col("b").alias("key"), F.col("a").alias("leader"), "score"))
    near = both.join(leaders, "leader").select("key", "leader", "leader_rank", "score")
    own = leaders.select(F.col("leader").alias("key"), "leader", "leader_rank", F.lit(100.0).alias("score"))
    # a key that leads keeps its own spellings; others look at leaders ranked before each spelling
    options = own.unionByName(near.join(leaders.select(F.col("leader").alias("key")), "key", "left_anti"))
    chosen = (sp.join(options, "key").where((F.col("leader") == F.col("key")) | (F.col("leader_rank") < F.col("rank")))
              .groupBy("value").agg(F.min_by("leader", F.struct(-F.col("score"), "leader_rank")).alias("leader")))
    return spellings.join(chosen, "value")


def canonical_entries(clustered: DataFrame, by: list[str] = [], cluster: str = "leader") -> DataFrame:
    """One entry per cluster: most frequent spelling, then shortest, then alphabetical."""
    shown = tx.display_name(F.col("value"))
    best = F.struct((-F.col("n")).alias("neg"), F.length(shown).alias("len"), tx.casefold(shown).alias("f"), F.col("value"))
    alias = F.struct(tx.casefold(F.col("value")).alias("f"), F.col("value").alias("v"))
    return (clustered.groupBy(*by, F.col(cluster).alias("key"))
            .agg(F.min_by(shown, best).alias("canonical_name"), F.sum("n").alias("frequency"),
                 F.transform(F.array_sort(F.collect_set(alias)), lambda x: x["v"]).alias("aliases")))


def exact_vocabulary(obs: DataFrame, by: list[str] = []) -> DataFrame:
    """Vocabulary without the fuzzy step: one entry per key."""
    return canonical_entries(count_spellings(obs, by), by, "key")


def build_vocabulary(obs: DataFrame, threshold: float = DEFAULTS.cluster_ratio) -> DataFrame:
    return canonical_entries(assign_leaders(count_spellings(obs, []), threshold))


def ordered(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.orderBy(tx.casefold(F.col("canonical_name")), "canonical_name")


def alias_reasons(vocabulary: DataFrame) -> DataFrame:
    """Why each alias was folded into its entry."""
    rows = vocabulary.select("canonical_name", "key", F.explode("aliases").alias("alias"))
    return rows.withColumn("reason", F.when(tx.display_name(F.col("alias")) == F.col("canonical_name"), "canonical_or_repeated")
                           .when(tx.entity_key(F.col("alias")) == F.col("key"), "legal_suffix_punctuation_or_vendor_code")
                           .otherwise("fuzzy_cluster"))


def alias_stats(vocabulary: DataFrame) -> DataFrame:
    r = alias_reasons(vocabulary)
    fuzzy = F.count_if(F.col("reason") == "fuzzy_cluster")
    return r.agg(F.count_distinct("key").alias("entries"), F.count("*").alias("aliases"),
                 fuzzy.alias("fuzzy"), F.count_if(F.col("reason") == "legal_suffix_punctuation_or_vendor_code").alias("by_rule"),
                 F.coalesce(F.bround(100 * fuzzy / F.count("*"), 2), F.lit(0.0)).alias("fuzzy_percent"))


# ---- ranking and resolution ------------------------------------------------------

def rank_names(keys: DataFrame, vocabulary: DataFrame, k: int = 3, chunk: int = scanning.CHUNK, sent: int = scanning.SENT) -> DataFrame:
    """The k most similar entries for each distinct key, ties in name order."""
    q = cut_lineage(keys.select("key").where(F.col("key") != "").distinct())
    e = cut_lineage(vocabulary.select(F.col("key").alias("entry_key"), "canonical_name"))
    if k == 1:  # an equal key scores 100 and nothing else does
        equal = q.join(e, F.col("key") == F.col("entry_key")).select(
            "key", "canonical_name", "entry_key", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
        rest = q.join(e.select(F.col("entry_key").alias("key")), "key", "left_anti")
        return equal.unionByName(_search_names(rest, e, 1, chunk, sent))
    return _search_names(q, e, k, chunk, sent)


def _search_names(q: DataFrame, e: DataFrame, k: int, chunk: int, sent: int) -> DataFrame:
    """Each chunk of the vocabulary gives its k best by bounded search; the k best of those stay."""
    # names are few bytes and much work: by their bytes Spark would put them all into one task
    q = q.select(F.col("key").alias("query"))
    q = q.repartition(max(1, -(-q.count() // SEARCHED)))
    found = scanning.scan(q, ["query"], "query", e, "entry_key", nearest_names(k), chunk, sent, name="canonical_name")
    named = found.withColumnRenamed("key", "entry_key").join(e, "entry_key").select(F.col("query").alias("key"), "canonical_name", "entry_key", "score")
    w = Window.partitionBy("key").orderBy(F.desc("score"), tx.casefold(F.col("canonical_name")), F.col("canonical_name"))
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_candidates(scored: DataFrame, item: str, k: int = 3) -> DataFrame:
    """Best score per name and item over all evidence, then the k best names."""
    best = scored.groupBy(item, "canonical_name").agg(F.max("score").alias("score"))
    w = Window.partitionBy(item).orderBy(F.desc("score"), "canonical_name")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def resolve_names(evidence: DataFrame, vocabulary: DataFrame, threshold: float, item: str = "row_no") -> DataFrame:
    """Evidence rows (item, value) to one name per item.  Two different confident
    leaders are a conflict and resolve to nothing."""
    ev = evidence.where(F.col("value").isNotNull()).select(item, tx.entity_key(F.col("value")).alias("key")).distinct()
    ranked = rank_names(ev, vocabulary)
    hits = ev.join(ranked, "key")
    leaders = (hits.where(F.col("rank") == 1).groupBy(item)
               .agg(F.count_distinct(F.when(F.col("score") >= threshold, F.col("canonical_name"))).alias("leaders")))
    cands = (top_candidates(hits.select(item, "canonical_name", "score"), item).groupBy(item)
             .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("canonical_name").alias("value"), F.col("score").alias("confidence")))).alias("c")))
    top = F.col("c")[0]
    good = (top["confidence"] >= threshold) & (F.col("leaders") <= 1)
    return cands.join(leaders, item).select(
        item, F.when(good, top["value"]).alias("canonical_name"),
        F.when(good, top["confidence"]).otherwise(F.lit(0.0)).alias("confidence"),
        (F.col("leaders") > 1).alias("conflict"),
        F.transform("c", lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"))).alias("candidates"))


def pairing(truth: DataFrame, row: str = "row_no") -> DataFrame:
    """brand key -> manufacturer; the last row that names both wins."""
    written = cut_lineage(truth.groupBy("brand_name", "manufacturer_name").agg(F.max(row).alias(row)))      # each pair of spellings is cleaned once
    named = written.select(row, tx.clean_optional(F.col("brand_name")).alias("b"), tx.clean_optional(F.col("manufacturer_name")).alias("m"))
    return (named.where(F.col("b").isNotNull() & F.col("m").isNotNull())
            .groupBy(tx.entity_key(F.col("b")).alias("brand_key")).agg(F.max_by("m", row).alias("manufacturer")))


def attach_ids(df: DataFrame, name: str, ids: DataFrame, out: str) -> DataFrame:
    """Official id of a canonical name by its key (ids: key, id)."""
    keyed = ids.select(F.col("key").alias("__k"), F.col("id").alias(out))
    return df.join(keyed, tx.entity_key(F.col(name)) == F.col("__k"), "left").drop("__k")


def with_lookup(items: DataFrame, cache: DataFrame, part_number: str = "mfg_part_num") -> DataFrame:
    """Cached manufacturer per part key.  `cache_hit` is true for a stored answer,
    also a negative one, false for a miss, and NULL without a usable key."""
    keyed = items.withColumn("part_key", tx.part_key(F.coalesce(F.col(part_number), F.lit(""))))
    stored = cache.select("part_key", F.col("manufacturer").alias("found"), F.col("confidence").alias("found_confidence"),
                          F.lit(True).alias("__present"))
    out = keyed.join(stored, "part_key", "left")
    return out.withColumn("cache_hit", F.when(F.col("part_key") != "", F.coalesce("__present", F.lit(False)))).drop("__present")


def lookup_work(items: DataFrame, cache: DataFrame, part_number: str = "mfg_part_num") -> DataFrame:
    """Distinct part keys that still have to be looked up."""
    keys = items.select(tx.part_key(F.coalesce(F.col(part_number), F.lit(""))).alias("part_key")).where("part_key <> ''").distinct()
    return keys.join(cache.select("part_key"), "part_key", "left_anti")


def merge_lookups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of stored and fresh answers, the latest per part key."""
    cols = [c for c in old.columns if c != "part_key"]
    return (old.unionByName(new).groupBy("part_key")
            .agg(F.max_by(F.struct(*cols), F.col("stored_at")).alias("__x")).select("part_key", "__x.*"))


def resolve_catalog(cleaned: DataFrame, brands: DataFrame, manufacturers: DataFrame, pairs: DataFrame,
                    cache: DataFrame | None = None, p: Params = DEFAULTS, item: str = "row_no") -> DataFrame:
    """Brand and manufacturer per cleaned row, with source, confidence and flags.

    Manufacturer precedence: the brand's paired manufacturer, then the part-number
    lookup when all brand columns are empty, then the distributor column at a
    capped confidence.
    """
    # rows that state the same brands resolve alike: each distinct triple is resolved once
    stated = cut_lineage(cleaned.select(*BRAND_FIELDS).distinct().withColumn("__set", F.monotonically_increasing_id()))
    brand = resolve_names(stated.select("__set", F.explode(F.array(*BRAND_FIELDS)).alias("value")), brands, p.brand_match, "__set").select(
        "__set", F.col("canonical_name").alias("brand"), F.col("confidence").alias("brand_confidence"),
        F.col("conflict").alias("brand_conflict"), F.col("candidates").alias("brand_candidates"))
    brand = stated.join(brand, "__set").withColumn("__bk", tx.entity_key(F.col("brand"))).join(
        pairs.select(F.col("brand_key").alias("__bk"), F.col("manufacturer").alias("paired")), "__bk", "left").drop("__bk", "__set")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in BRAND_FIELDS])
    rows = cleaned.join(brand.withColumnsRenamed({c: f"__{c}" for c in BRAND_FIELDS}), same, "left").drop(*[f"__{c}" for c in BRAND_FIELDS])
    no_brand = F.coalesce(*BRAND_FIELDS).isNull() & F.col("paired").isNull()
    if cache is not None:
        rows = with_lookup(rows.withColumn("__mpn", F.when(no_brand, F.col("mfg_part_num"))), cache, "__mpn").drop("__mpn", "part_key")
    else:
        rows = rows.select("*", F.lit(None).cast("string").alias("found"), F.lit(None).cast("double").alias("found_confidence"),
                           F.lit(None).cast("boolean").alias("cache_hit"))
    makers = cut_lineage(cleaned.select("part_manuf").distinct()).withColumn("key", tx.entity_key(F.col("part_manuf")))
    dist = makers.join(rank_names(makers, manufacturers, 1), "key").select("part_manuf", F.col("canonical_name").alias("fallback"), F.col("score").alias("__fs"))
    rows = rows.join(dist, "part_manuf", "left")
    source = (F.when(F.col("paired").isNotNull(), "brand_manufacturer_pair")
              .when(F.col("found").isNotNull(), "mpn_web_lookup")
              .when(F.col("fallback").isNotNull(), "part_manuf_fallback"))
    conf = (F.when(F.col("paired").isNotNull(), F.lit(p.pair_confidence))
            .when(F.col("found").isNotNull(), F.col("found_confidence"))
            .when(F.col("fallback").isNotNull(), F.least(F.col("__fs"), F.lit(p.fallback_cap))).otherwise(F.lit(0.0)))
    return rows.select(
        *cleaned.columns, "brand", F.coalesce("brand_confidence", F.lit(0.0)).alias("brand_confidence"),
        F.coalesce("brand_conflict", F.lit(False)).alias("brand_conflict"), "brand_candidates",
        F.coalesce("paired", "found", "fallback").alias("manufacturer"), conf.alias("manufacturer_confidence"),
        source.alias("manufacturer_source"),
        (no_brand & F.lit(cache is not None)).alias("lookup_attempted"), "cache_hit")


def resolution_flags(resolved: DataFrame, p: Params = DEFAULTS, item: str = "row_no") -> DataFrame:
    """Long (item, code, field) review flags of the resolution step."""
    weak = F.col("manufacturer").isNull() | (F.col("manufacturer_confidence") < p.manufacturer_match)
    flag = lambda cond, code, field: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    flags = F.array_compact(F.array(
        flag(weak, "manufacturer_unresolved", "manufacturer"),
        flag(F.col("manufacturer_source") == "part_manuf_fallback", "low_confidence_distributor_field_used", "manufacturer"),
        flag(F.col("brand").isNull(), "brand_unresolved", "brand"),
        flag(F.col("brand_conflict"), "brand_conflict", "brand")))
    return resolved.select(item, F.explode(flags).alias("f")).select(item, "f.code", "f.field")
