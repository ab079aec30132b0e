"""Deterministic compliance and the merge of supplied verdicts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import units as un
from attestry.functions.text import let
from attestry.operators.measures import with_parsed

KEY = ["item_id", "label", "idx"]


def compliance(extracted: DataFrame, normalized: DataFrame) -> DataFrame:
    """Vocabulary and unit compliance per extracted value."""
    n = normalized.select(*KEY, F.col("value").alias("nv"), F.col("uom").alias("nu"))
    named = F.col("uom").isNull() | un.canonical_unit(F.col("uom")).isNotNull()
    measure = let(un.split_measure(F.coalesce("value", F.lit("")), F.col("uom")), lambda m: F.struct((m["valid"] & named).alias("sound"), m["uom"].alias("uom")))
    agrees = F.col("nu").isNull() | F.col("m.uom").eqNullSafe(F.col("nu"))
    return with_parsed(extracted.select(*KEY, "value", "uom"), ["value", "uom"], measure).join(n, KEY, "left").select(
        *KEY, F.col("nv").isNotNull().alias("vocabulary_compliant"), (F.col("m.sound") & agrees).alias("uom_compliant"))


def judge_verdicts(extracted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add `accepted` to verdict rows: first one, by position, for a known label."""
    known = extracted.select("item_id", "label", F.lit(True).alias("__k")).distinct()
    first = verdicts.groupBy("item_id", "label").agg(F.min("pos").alias("__first"))
    return (verdicts.join(known, ["item_id", "label"], "left").join(first, ["item_id", "label"])
            .select(*verdicts.columns, (F.col("__k").isNotNull() & (F.col("pos") == F.col("__first"))).alias("accepted")))


def first_verdicts(verdicts: DataFrame, failed: DataFrame) -> DataFrame:
    """(item_id, label, idx, entailment): the first verdict on each label, by position, of items that did not fail."""
    first = verdicts.groupBy("item_id", "label").agg(F.min_by("entailment", "pos").alias("entailment"))
    return first.where("entailment is not null").join(failed.select("item_id").distinct(), "item_id", "left_anti").withColumn("idx", F.lit(0))


def merge_verdicts(extracted: DataFrame, verdicts: DataFrame, checked: DataFrame, failed: DataFrame) -> DataFrame:
    """One verdict per extracted value; missing or failed ones are ambiguous with
    confidence zero and count as non-compliant."""
    good = judge_verdicts(extracted, verdicts).where("accepted").select("item_id", "label", "entailment", "confidence", "reasoning")
    bad = failed.select("item_id", F.lit(True).alias("failed")).distinct()
    rows = (extracted.select(*KEY, "value").join(bad, "item_id", "left").join(good, ["item_id", "label"], "left")
            .join(checked, KEY))
    have = F.col("failed").isNull() & F.col("entailment").isNotNull()
    return rows.select(
        *KEY, "value", F.when(have, F.col("entailment")).otherwise("ambiguous").alias("entailment"),
        F.when(have, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(have, F.col("reasoning")).when(F.col("failed"), "Verification failed.")
        .otherwise("The model omitted this verification result.").alias("reasoning"),
        (have & F.col("vocabulary_compliant")).alias("vocabulary_compliant"),
        (have & F.col("uom_compliant")).alias("uom_compliant"),
        F.when(F.col("failed"), "verification_failed").when(~have, "verification_incomplete").alias("flag"))
