"""Field status, coverage percentages, review routing and truth evaluation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.params import DEFAULTS, Params


def percent(part: Column, whole: Column) -> Column:
    """Half-even percentage to two decimals; NULL for an empty denominator."""
    return F.bround(100.0 * part / F.nullif(whole, F.lit(0)), 2)


def entity_status(p: Params = DEFAULTS) -> Column:
    """ARRAY<STRUCT(field, okay)> of a row's names and path."""
    good = lambda v, c, bar: F.coalesce(F.col(v).isNotNull() & (F.col(c) >= bar), F.lit(False))
    return F.array(*[F.struct(F.lit(n).alias("field"), ok.alias("okay")) for n, ok in (
        ("manufacturer", good("manufacturer", "manufacturer_confidence", p.manufacturer_match)),
        ("brand", good("brand", "brand_confidence", p.brand_match)),
        ("classpath", good("classpath", "class_confidence", p.classify_accept)))])


def description_status(field: Column, value: Column, compliant: Column) -> Column:
    """STRUCT(field, okay) of one description."""
    return F.struct(F.concat(F.lit("description:"), field).alias("field"), ((F.length(F.coalesce(value, F.lit(""))) > 0) & compliant).alias("okay"))


def verdict_good(p: Params = DEFAULTS) -> Column:
    return (F.col("entailment") == "supported") & (F.col("confidence") >= p.verification_confidence) & F.col("vocabulary_compliant") & F.col("uom_compliant")


def status_rows(base: DataFrame, expected: DataFrame, final: DataFrame, verdicts: DataFrame,
                descriptions: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Long (item_id, field, okay) status of names, path, attributes, descriptions."""
    entity = base.select("item_id", F.inline(entity_status(p)))
    v = verdicts.withColumn("__v", verdict_good(p)).select("item_id", "label", "__v")
    f = final.where(F.col("value").isNotNull()).select("item_id", "label", F.lit(True).alias("__f")).distinct()
    attrs = (expected.join(f, ["item_id", "label"], "left").join(v, ["item_id", "label"], "left")
             .select("item_id", F.concat(F.lit("attribute:"), "label").alias("field"),
                     F.coalesce(F.col("__f") & F.col("__v"), F.lit(False)).alias("okay")))
    desc = descriptions.select("item_id", description_status(F.col("field"), F.col("value"), F.col("compliant")).alias("s")).select("item_id", "s.*")
    return entity.unionByName(attrs).unionByName(desc)


def flag_rows(status: DataFrame) -> DataFrame:
    """(item_id, field, message) for everything that is not okay."""
    name = F.regexp_replace("field", "^(attribute|description):", "")
    message = (F.when(F.col("field").startswith("attribute:"), F.concat(name, F.lit(" lacks supported, confident, vocabulary-compliant evidence.")))
               .when(F.col("field").startswith("description:"), F.concat(name, F.lit(" is blank or outside its character requirements.")))
               .otherwise(F.concat(F.initcap(name), F.lit(" is unresolved or low confidence."))))
    return status.where(~F.col("okay")).select("item_id", "field", message.alias("message"))


def percentages(status: DataFrame, expected: DataFrame, extracted: DataFrame, normalized: DataFrame,
                verdicts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Coverage figures per item, each from its own counted numerator and denominator."""
    cover = status.groupBy("item_id").agg(F.count_if("okay").alias("resolved"), F.count("*").alias("total"))
    has = lambda df, name: df.select("item_id", "label", F.lit(True).alias(name)).distinct()
    ok = verdicts.select("item_id", "label", F.col("vocabulary_compliant").alias("__voc"))
    attrs = (expected.join(has(extracted.where(F.col("value").isNotNull()), "__e"), ["item_id", "label"], "left")
             .join(has(normalized, "__n"), ["item_id", "label"], "left").join(ok, ["item_id", "label"], "left")
             .groupBy("item_id").agg(
                 F.count("*").alias("expected"), F.count_if(F.col("__e").isNotNull()).alias("produced"),
                 F.count_if(F.col("__e").isNotNull() & F.col("__n").isNotNull()).alias("vocab_total"),
                 F.count_if(F.col("__e").isNotNull() & F.col("__n").isNotNull() & F.col("__voc")).alias("vocab_ok")))
    filled = F.length(F.coalesce("value", F.lit(""))) > 0
    desc = descriptions.groupBy("item_id").agg(F.count_if(filled).alias("desc_total"), F.count_if(filled & F.col("compliant")).alias("desc_ok"))
    out = cover.join(attrs, "item_id", "left").join(desc, "item_id", "left").na.fill(0)
    return out.select(
        "item_id", "resolved", "total", F.coalesce(percent(F.col("resolved"), F.col("total")), F.lit(0.0)).alias("coverage_percent"),
        percent(F.col("vocab_ok"), F.col("vocab_total")).alias("vocabulary_percent"), "vocab_total",
        percent(F.col("produced"), F.col("expected")).alias("attribute_percent"), "produced", "expected",
        percent(F.col("desc_ok"), F.col("desc_total")).alias("character_percent"), "desc_ok", "desc_total")


def route(status: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """Review whenever any field is not okay or adjudication asked for it."""
    asked = adjudicated.groupBy("item_id").agg(F.max("needs_review").alias("asked"))
    bad = status.groupBy("item_id").agg(F.max(~F.col("okay")).alias("bad"))
    return bad.join(asked, "item_id", "left").select("item_id", (F.col("bad") | F.coalesce("asked", F.lit(False))).alias("routed"))


def review_queue(routed: DataFrame, flags: DataFrame) -> DataFrame:
    return flags.join(routed.where("routed").select("item_id"), "item_id", "left_semi")


# ---- truth evaluation --------------------------------------------------------------------

SCALARS = (("manufacturer", "manufacturer_name", False), ("brand", "brand_name", True))
DESC_PAIRS = ("mobile_desc", "invoice_desc", "short_desc", "long_desc1", "retail_desc", "marketing_description")


def truth_counts(records: DataFrame, truth: DataFrame, actual: DataFrame, wanted: DataFrame) -> DataFrame:
    """Long (row_no, group, correct, compared).  Names count only when the truth is
    filled; attributes and descriptions always count, possibly over nothing."""
    r = records.join(truth.select("row_no", *[F.col(c).alias(f"t_{c}") for c in ("manufacturer_name", "brand_name", *DESC_PAIRS)]), "row_no")
    same = lambda a, b, tm=False: (tx.comparison_text(F.col(a), tm) == tx.comparison_text(F.col(b), tm))
    filled = lambda c: F.trim(f"t_{c}") != ""
    scalar = [F.when(filled(c), F.struct(F.lit(n).alias("group"), same(n, f"t_{c}", tm).cast("bigint").alias("correct"),
                                         F.lit(1).cast("bigint").alias("compared"))) for n, c, tm in SCALARS]
    n_ok, n_all = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for c in DESC_PAIRS:
        n_all = n_all + F.when(filled(c), 1).otherwise(0)
        n_ok = n_ok + F.when(filled(c) & same(c, f"t_{c}"), 1).otherwise(0)
    desc = F.struct(F.lit("descriptions").alias("group"), n_ok.alias("correct"), n_all.alias("compared"))
    rows = r.select("row_no", F.inline(F.array_compact(F.array(*scalar, desc))))
    a = actual.select("row_no", "label", F.col("value").alias("av"), F.col("uom").alias("au"))
    hit = (F.coalesce(tx.comparison_text(F.col("av")) == tx.comparison_text(F.col("value")), F.lit(False)) & F.col("au").eqNullSafe(F.col("uom")))
    attr = wanted.join(a, ["row_no", "label"], "left").groupBy("row_no").agg(
        F.count_if(hit).alias("correct"), F.count("*").alias("compared"))
    attr = records.select("row_no").join(attr, "row_no", "left").na.fill(0).select(
        "row_no", F.lit("attributes").alias("group"), "correct", "compared")
    return rows.unionByName(attr)


def accuracy(counts: DataFrame) -> DataFrame:
    """Long (row_no, group, percent) with a micro overall row; a group without
    comparisons is 0, and `classpath` is NULL because it cannot be compared."""
    rate = lambda c, n: F.coalesce(percent(c, n), F.lit(0.0))
    per = counts.select("row_no", "group", rate(F.col("correct"), F.col("compared")).alias("percent"))
    whole = counts.groupBy("row_no").agg(rate(F.sum("correct"), F.sum("compared")).alias("percent")).select("row_no", F.lit("overall").alias("group"), "percent")
    none = counts.select("row_no").distinct().select("row_no", F.lit("classpath").alias("group"), F.lit(None).cast("double").alias("percent"))
    return per.unionByName(whole).unionByName(none)


def macro_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group").agg(F.bround(F.avg("percent"), 2).alias("percent"))


def gap_rows(truth: DataFrame, counts: DataFrame) -> DataFrame:
    """(row_no, gap) sentences about blank truth fields and differing names."""
    blank = lambda c, n: F.when(F.trim(c) == "", F.lit(f"Ground truth leaves {n} blank; excluded from accuracy denominator."))
    path = F.when(F.trim("classpath") != "", F.lit("Classpath accuracy is not directly comparable; excluded from accuracy denominator."))
    own = truth.select("row_no", F.explode(F.array_compact(F.array(blank("unspsc", "UNSPSC"), blank("country_of_origin", "Country Of Origin"), path))).alias("gap"))
    wrong = counts.where(F.col("group").isin("manufacturer", "brand") & (F.col("correct") == 0)).select(
        "row_no", F.concat(F.initcap("group"), F.lit(" differs from the populated ground-truth value.")).alias("gap"))
    return own.unionByName(wrong)
