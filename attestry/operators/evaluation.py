"""Reports over finished records: evaluation, summaries, tiers, job state."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import leaf
from attestry.operators.auditing import percent
from attestry.operators.payloads import confidence_tier


def evaluation(audits: DataFrame) -> DataFrame:
    """One report row.  Vocabulary compliance weights the already rounded row
    percentages by their denominators; the other rates are plain ratios of sums."""
    row = percent(F.col("vocab_ok"), F.col("vocab_total"))
    weighted = F.sum((row * F.col("vocab_total")).cast("decimal(20,4)"))
    return audits.agg(
        F.count("*").alias("evaluated_rows"),
        F.bround(weighted.cast("double") / F.nullif(F.sum("vocab_total"), F.lit(0)), 2).alias("vocabulary_percent"),
        F.sum("vocab_total").alias("vocab_total"),
        percent(F.sum("produced"), F.sum("expected")).alias("attribute_percent"),
        percent(F.sum("desc_ok"), F.sum("desc_total")).alias("character_percent"),
        F.coalesce(percent(F.count_if("routed"), F.count("*")), F.lit(0.0)).alias("routed_percent"))


def summary_columns() -> list[Column]:
    done = F.col("state") != "failed"
    got = done & F.col("code").isNotNull()
    n = F.count_if(done)
    mean = lambda cond, d: F.bround(F.sum(F.when(cond, F.col("confidence").cast("decimal(12,6)"))).cast("double") / F.nullif(F.count_if(cond), F.lit(0)), d)
    return [F.count("*").alias("attempted"), n.alias("completed"), F.count_distinct(F.when(got, F.col("code"))).alias("distinct_codes"),
            percent(F.count_if(got), n).alias("classified_percent"), mean(done, 4).alias("mean_confidence_all"),
            mean(got, 4).alias("mean_confidence_resolved"),
            percent(F.count_if(done & (F.col("produced") > 0)), n).alias("with_attributes_percent"),
            percent(F.sum(F.when(done, F.col("produced"))), F.sum(F.when(done, F.col("expected")))).alias("yield_percent"),
            percent(F.count_if(done & F.col("routed")), n).alias("review_percent")]


def summary(records: DataFrame) -> DataFrame:
    return records.agg(*summary_columns())


def by_category(records: DataFrame) -> DataFrame:
    cat = leaf(F.coalesce("classpath", F.lit("Unresolved"))).alias("category")
    return records.where(F.col("state") != "failed").groupBy(cat).agg(
        F.count("*").alias("rows"), F.count("code").alias("classified"), F.count_if(F.col("produced") > 0).alias("with_attributes"),
        F.bround(F.sum(F.col("confidence").cast("decimal(12,6)")).cast("double") / F.count("*"), 3).alias("mean_confidence"),
        F.count_if("routed").alias("reviewed"))


def tiers(obs: DataFrame) -> DataFrame:
    """Observations, retained and plausible shares by entailment and by tier at once."""
    t = obs.withColumn("tier", confidence_tier(F.col("confidence")))
    return t.groupingSets([["entailment"], ["tier"]], "entailment", "tier").agg(
        F.count("*").alias("observations"), F.count_if("retained").alias("retained"),
        percent(F.count_if("retained"), F.count("*")).alias("retained_percent"),
        percent(F.count_if("plausible"), F.count("*")).alias("plausible_percent"))


def operations(records: DataFrame) -> DataFrame:
    tried = F.coalesce("lookup_attempted", F.lit(False))
    rate = lambda a, b: F.round(100.0 * a / F.nullif(b, F.lit(0)), 1)
    return records.agg(F.count("*").alias("processed"), F.count_if(tried).alias("lookups"),
                       rate(F.count_if(tried & F.col("cache_hit")), F.count_if(tried)).alias("cache_hit_percent"),
                       rate(F.count_if("adjudicated"), F.count("*")).alias("conflict_percent"),
                       F.count_if(~F.col("adjudicated")).alias("skipped"))


def job_status(rows: DataFrame, job: str) -> DataFrame:
    """Counts and state per job: queued until a row finished, running until all did."""
    done, failed = F.count_if(F.col("state") == "completed"), F.count_if(F.col("state") == "failed")
    state = (F.when(done + failed == 0, "queued").when(done + failed < F.count("*"), "running")
             .when(failed > 0, "completed_with_errors").otherwise("completed"))
    return rows.groupBy(job).agg(F.count("*").alias("total_rows"), done.alias("completed_rows"), failed.alias("failed_rows"), state.alias("status"))


def latest_records(records: DataFrame, n: int = 100) -> DataFrame:
    """Newest record per id, and of those the n newest (the list length is the feature)."""
    cols = [c for c in records.columns if c != "item_id"]
    newest = records.groupBy("item_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("__r")).select("item_id", "__r.*")
    return newest.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
