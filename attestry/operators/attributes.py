"""Attribute tables learned from wide truth rows, allowed values, and the
constraint of extracted values to them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions import similarity as sim
from attestry.functions import text as tx
from attestry.functions import units as un
from attestry.operators.buckets import with_bucket
from attestry.operators.matching import grams
from attestry.operators.measures import with_parsed
from attestry.params import DEFAULTS
from attestry.session import cut_lineage, stored

TRIPLE = ("attribute_label_{n}", "attribute_value_{n}", "attribute_uom_{n}")


def unpivot_triples(df: DataFrame, keys: list[str], slots: int, names: tuple[str, str, str] = TRIPLE) -> DataFrame:
    """Long (keys, slot, label, value, uom) rows of a wide row's numbered triples."""
    cells = F.array(*[F.struct(F.lit(n).alias("slot"), *[
        F.trim(F.coalesce(F.col(f"`{name.format(n=n)}`"), F.lit(""))).alias(a)
        for name, a in zip(names, ("label", "value", "uom"))]) for n in range(1, slots + 1)])
    return df.select(*keys, F.inline(cells))


def slot_report(long: DataFrame) -> DataFrame:
    """Per slot: filled labels, values without a label, and unknown units."""
    return long.groupBy("slot").agg(
        F.count_if(F.col("label") != "").alias("labels"),
        F.count_if((F.col("label") == "") & (F.col("value") != "")).alias("value_without_label"),
        F.count_if((F.col("uom") != "") & un.canonical_unit(F.col("uom")).isNull()).alias("unknown_unit"))


def first_seen(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.struct(*order)).alias("seen"))


def _place() -> Column:
    """Row and slot as one number: its minimum needs no sort of all rows."""
    return F.col("row_no").cast("long") * 65536 + F.col("slot")


def _seen(long: DataFrame) -> Column:
    """STRUCT(row_no, slot) of the place `at`."""
    types = {c: long.schema[c].dataType for c in ("row_no", "slot")}
    return F.struct(F.shiftright("at", 16).cast(types["row_no"]).alias("row_no"),
                    F.col("at").bitwiseAND(F.lit(65535)).cast(types["slot"]).alias("slot")).alias("seen")


def expected_labels(long: DataFrame) -> DataFrame:
    """(classpath, label, seen): distinct labels per path in first-seen order."""
    ok = long.where((F.col("classpath") != "") & (F.col("label") != ""))
    return ok.groupBy("classpath", "label").agg(F.min(_place()).alias("at")).select("classpath", "label", _seen(long))


def value_vocabulary(long: DataFrame) -> DataFrame:
    """(classpath, label, value, uom, seen): distinct normalized values in first-seen
    order; a label without any usable value keeps one NULL row."""
    ok = long.where((F.col("classpath") != "") & (F.col("label") != ""))
    stated = stored(ok.groupBy("classpath", "label", "value", "uom").agg(F.min(_place()).alias("at")), "stated-values")
    m = un.normalize_measure(F.col("label"), F.nullif(F.col("value"), F.lit("")), F.nullif(F.col("uom"), F.lit("")))
    n = with_parsed(stated, ["label", "value", "uom"], F.when(F.col("value") != "", m)).withColumn("v", F.when(F.col("m.valid"), F.col("m")))
    rows = n.groupBy("classpath", "label", F.col("v.value").alias("value"), F.col("v.uom").alias("uom")).agg(F.min("at").alias("at"))
    rows = stored(rows.select("classpath", "label", "value", "uom", _seen(long)), "value-vocabulary")
    filled = rows.where(F.col("value").isNotNull())
    bare = rows.where(F.col("value").isNull()).join(filled.select("classpath", "label").distinct(), ["classpath", "label"], "left_anti")
    return filled.unionByName(bare)


def product_names(truth: DataFrame) -> DataFrame:
    """Most common product name per path, first seen on ties."""
    named = truth.select("row_no", F.trim("classpath").alias("classpath"), F.trim("product_name").alias("product_name"))
    counted = named.where("classpath <> '' AND product_name <> ''").groupBy("classpath", "product_name").agg(
        F.count("*").alias("n"), F.min("row_no").alias("first"))
    return counted.groupBy("classpath").agg(F.min_by("product_name", F.struct(-F.col("n"), "first")).alias("product_name"),
                                            F.max("n").alias("n"))


def length_limits(truth: DataFrame) -> DataFrame:
    """One row of description limits: two fixed, the others the longest observed."""
    longest = lambda c: F.coalesce(F.max(F.length(c)), F.lit(0)).cast("bigint")
    return truth.agg(F.lit(80).cast("bigint").alias("mobile"), F.lit(40).cast("bigint").alias("invoice"),
                     longest("short_desc").alias("short"), longest("long_desc1").alias("long"),
                     longest("retail_desc").alias("retail"), longest("marketing_description").alias("marketing"))


def truth_attributes(long: DataFrame, key: str = "row_no") -> DataFrame:
    """(key, label, value, uom): stated values with canonical units; a repeated label's
    last slot wins.  Rows are dealt by key and label first: grouped where they are read, all of a large split would be sorted."""
    ok = long.where((F.col("label") != "") & (F.col("value") != "")).repartition(key, "label")
    return ok.groupBy(key, "label").agg(F.max_by(F.struct("value", un.canonical_unit(F.col("uom")).alias("uom")), "slot").alias("__x")
                                        ).select(key, "label", "__x.*")


def snapshot(obs: DataFrame) -> DataFrame:
    """Observed spellings per canonical value, each once in first-seen order, with the
    reason it was folded."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    trace = F.when(~same("observed_value", "value") & same("observed_uom", "uom"), "fuzzy_collapse")
    reason = (F.when(F.col("source") == "trace", trace).otherwise(F.lit(None)))
    reason = F.coalesce(reason, F.when(~same("observed_value", "value") | ~same("observed_uom", "uom"), "uom_or_fraction_rule"),
                        F.lit("first_seen_original"))
    first = obs.withColumn("reason", reason).groupBy("classpath", "label", "value", "uom", "observed_value", "observed_uom").agg(
        F.min(F.struct("seq", "source", "reason")).alias("s"))
    return first.groupBy("classpath", "label", "value", "uom").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("s.seq").alias("seq"), F.col("observed_value").alias("v"), F.col("observed_uom").alias("u"),
        F.col("s.source").alias("source"), F.col("s.reason").alias("reason")))),
        lambda a: F.struct(a["v"].alias("value"), a["u"].alias("uom"), a["source"].alias("source"), a["reason"].alias("reason"))).alias("aliases"))


def labels_or_generic(paths: DataFrame, nearest: DataFrame, expected: DataFrame) -> DataFrame:
    """(classpath, seq, label): labels of the nearest known path, or the generic list."""
    known = nearest.join(expected.withColumnRenamed("classpath", "path"), "path").select("classpath", F.col("seen.row_no").alias("a"), F.col("seen.slot").alias("b"), "label")
    generic = (paths.select("classpath").distinct().join(nearest, "classpath", "left_anti")
               .select("classpath", F.posexplode(F.array(*[F.lit(x) for x in fv.GENERIC_LABELS])).alias("b", "label"))
               .select("classpath", F.lit(0).cast("bigint").alias("a"), "b", "label"))
    return known.unionByName(generic)


def allowed_map(values: DataFrame) -> DataFrame:
    """MAP<label, ordered values> per path."""
    per = values.where(F.col("value").isNotNull()).groupBy("classpath", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("vals"))
    return per.groupBy("classpath").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "vals")))).alias("lovs"))


# ---- constraint ----------------------------------------------------------------------------

_BUCKET = ["classpath", "label"]


def learned_first(values: DataFrame, vocabulary: DataFrame, closed: DataFrame, order: list[str]) -> DataFrame:
    """First valid value of each bucket that is neither filled nor closed."""
    ok = values.where(F.col("valid") & (F.col("value") != "") & F.col("classpath").isNotNull())
    open_ = ok.join(vocabulary.where(F.col("value").isNotNull()).select(*_BUCKET).distinct(), _BUCKET, "left_anti").join(
        closed.select(*_BUCKET).distinct(), _BUCKET, "left_anti")
    return open_.groupBy(*_BUCKET).agg(F.min_by(F.struct("value", "uom"), F.struct(*order)).alias("__x")).select(*_BUCKET, "__x.*")


def blocking_grams(key: Column) -> Column:
    """Block keys that two comparison keys of composite score >= 90 always share:
    a word, a trigram of either word order, or, for keys that may contain a very
    short one, single characters and pairs."""
    words = F.split(key, " ")
    by_word = F.array_join(F.array_sort(words), " ")
    short = F.when(F.length(key) < 16, F.concat(grams(key, 1), grams(key, 2)))
    return F.array_distinct(F.concat(words, grams(key, 3), grams(by_word, 3), F.coalesce(short, F.array().cast("array<string>"))))


def constrain(values: DataFrame, vocabulary: DataFrame, closed: DataFrame, order: list[str],
              threshold: float = DEFAULTS.attribute_match) -> DataFrame:
    """Match distinct (classpath, label, value, uom) inputs to their bucket.

    Returns the input columns with `match_value`, `match_uom`, `score` for accepted
    rows.  An equal comparison key scores 1; only the rest is compared, with bucket
    values of the same unit that share a block key.
    """
    # the input shrinks to its distinct values, written once: every step below reads those
    ok = values.where(F.col("valid") & (F.col("value") != "") & F.col("classpath").isNotNull())
    asked = cut_lineage(ok.groupBy(*_BUCKET, "value", "uom").agg(F.min(F.struct(*order)).alias("__o")))
    learned = learned_first(asked.withColumn("valid", F.lit(True)), vocabulary, closed, ["__o"])
    seeds = vocabulary.where(F.col("value").isNotNull()).select(*_BUCKET, "value", "uom", "seq").unionByName(
        learned.withColumn("seq", F.lit(0).cast("bigint")))
    unit = F.coalesce("uom", F.lit(""))
    entries = seeds.select(*_BUCKET, F.col("value").alias("match_value"), F.col("uom").alias("match_uom"), "seq",
                           unit.alias("__u"), tx.comparison_key(F.col("value")).alias("__k"))
    wanted = asked.drop("__o").withColumn("__u", unit).withColumn("__q", tx.comparison_key(F.col("value")))
    on = [*_BUCKET, "__u"]
    first = entries.groupBy(*on, "__k").agg(F.min_by(F.struct("match_value", "match_uom"), F.struct("seq", "match_value")).alias("m"))
    equal = wanted.join(first.withColumnRenamed("__k", "__q"), [*on, "__q"]).select(*_BUCKET, "value", "uom", "m.*", F.lit(1.0).alias("score"))
    rest = wanted.join(first.select(*on, F.col("__k").alias("__q")), [*on, "__q"], "left_anti").where("__q <> ''")
    pairs = (rest.select(*on, "__q", F.explode(blocking_grams(F.col("__q"))).alias("g")).distinct()
             .join(entries.select(*on, "__k", F.explode(blocking_grams(F.col("__k"))).alias("g")).distinct(), [*on, "g"])
             .select(*on, "__q", "__k").distinct())
    # similarity depends on the two keys alone: score each distinct pair once
    scores = pairs.select("__q", "__k").distinct().withColumn("score", sim.composite_score("__q", "__k") / 100).where(F.col("score") >= threshold)
    near = (rest.join(pairs.join(scores, ["__q", "__k"]), [*on, "__q"]).join(entries, [*on, "__k"])
            .groupBy(*_BUCKET, "value", F.col("uom"))
            .agg(F.min_by(F.struct("match_value", "match_uom", "score"), F.struct(-F.col("score"), "seq", "match_value")).alias("m"))
            .select(*_BUCKET, "value", "uom", "m.*"))
    return equal.unionByName(near)


def normalize_extracted(extracted: DataFrame, item_paths: DataFrame) -> DataFrame:
    """Extracted rows with their path and parsed measure (value, uom, valid)."""
    m = un.normalize_measure(F.col("label"), F.col("value"), F.col("uom"))
    parsed = with_parsed(extracted.select("item_id", "label", "idx", "value", "uom"), ["label", "value", "uom"], m)
    return parsed.join(item_paths, "item_id", "left").select(
        "item_id", "label", "idx", "classpath", F.col("value").alias("raw_value"), F.col("uom").alias("raw_uom"), "m").select("item_id", "label", "idx", "classpath", "raw_value", "raw_uom", "m.*")


def bucketed(values: DataFrame, vocabulary: DataFrame, closed: DataFrame, order: list[str], cutoff: float = DEFAULTS.category_cutoff) -> DataFrame:
    """Add `bucket`: the path whose values a row is held to, which for a path without own values is a similar one."""
    known = vocabulary.select(*_BUCKET).unionByName(closed.select(*_BUCKET))
    return cut_lineage(with_bucket(values, known, order, F.col("valid") & (F.col("value") != ""), cutoff))


def in_bucket(values: DataFrame) -> DataFrame:
    """Bucketed rows under the path of their bucket."""
    return values.withColumn("classpath", F.col("bucket")).drop("bucket")


def normalize_stage(extracted: DataFrame, item_paths: DataFrame, vocabulary: DataFrame, closed: DataFrame,
                    threshold: float = DEFAULTS.attribute_match, cutoff: float = DEFAULTS.category_cutoff) -> DataFrame:
    """Canonical value and unit per extracted row, or NULL with the reason."""
    n = bucketed(normalize_extracted(extracted, item_paths), vocabulary, closed, ["item_id", "idx", "label"], cutoff)
    hit = constrain(in_bucket(n), vocabulary, closed, ["item_id", "idx", "label"], threshold)
    keyed = lambda df: df.withColumn("__u", F.coalesce("uom", F.lit("")))
    joined = keyed(n).join(keyed(hit.withColumnRenamed("classpath", "bucket")).drop("uom", "score"), ["bucket", "label", "value", "__u"], "left")
    matched = F.col("match_value").isNotNull() & F.col("valid")
    reason = F.when(~matched, F.when(~F.col("valid"), "unit_not_controlled").otherwise("value_not_in_vocabulary"))
    return joined.select("item_id", "label", "idx", "classpath", F.when(matched, F.col("match_value")).alias("value"),
                         F.when(matched, F.col("match_uom")).alias("uom"), reason.alias("reason"))
