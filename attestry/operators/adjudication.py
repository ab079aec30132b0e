"""Conflict detection and the settlement of supplied decisions.

Candidates are long rows keyed (item_id, label, candidate_id); decisions carry the
selected id and the rejected ids as ARRAY<STRING>.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.functions import units as un
from attestry.session import stored

LABEL = ["item_id", "label"]
PICKED = ["candidate_id", "value", "uom", "source_type", "priority"]


def source_priority(c: Column) -> Column:
    return F.when(c == "manufacturer_site", 2).when(c == "description", 1).otherwise(0)


def semantic_key(label: Column, value: Column, uom: Column) -> Column:
    """STRUCT(key, uom): comparable form, or the raw pair when the unit is invalid."""
    return tx.let(un.normalize_measure(label, value, uom), lambda m: F.when(
        m["valid"], F.struct(tx.comparison_key(m["value"]).alias("k"), m["uom"].alias("u"))
    ).otherwise(F.struct(F.coalesce(value, F.lit("")).alias("k"), uom.alias("u"))))


def pair_by_position(extracted: DataFrame, normalized: DataFrame) -> DataFrame:
    n = normalized.select("item_id", "label", "idx", F.col("value").alias("norm_value"), F.col("uom").alias("norm_uom"))
    return extracted.join(n, ["item_id", "label", "idx"], "left")


FORM = ["value", "uom", "source_type"]


def _form(kind: str, at) -> list[Column]:
    return [F.concat(F.lit(kind + ":"), F.col("idx").cast("string")).alias("candidate_id"), F.lit(kind).alias("kind"), F.col("idx").alias("lineage"),
            *[at(c).alias(c) for c in FORM], source_priority(at("source_type")).alias("priority")]


def candidates(extracted: DataFrame, normalized: DataFrame) -> DataFrame:
    """Extracted values and their non-NULL normalized forms, with lineage and priority; one join, no union.  An extracted
    position has at most one normalized form."""
    n = normalized.where(F.col("value").isNotNull()).select(*LABEL, "idx", F.struct(*FORM).alias("n"))
    own, other = (F.struct(*_form(kind, at)) for kind, at in (("extracted", F.col), ("normalized", lambda c: F.col("n")[c])))
    both = F.when(F.col("n").isNull(), F.array(own)).otherwise(F.array(own, other))
    return extracted.select(*LABEL, "idx", *FORM).join(n, [*LABEL, "idx"], "left").select(*LABEL, F.inline(both))


def listed(extracted: DataFrame, normalized: DataFrame) -> DataFrame:
    """The rows of `candidates` without its join, for values that are written and read at no cost twice."""
    rows = lambda df, kind: df.select(*LABEL, *_form(kind, F.col))
    return rows(extracted, "extracted").unionByName(rows(normalized.where(F.col("value").isNotNull()), "normalized"))


def measure_ids(cands: DataFrame) -> DataFrame:
    """(label, value, uom, sk): a number for the semantic key of each distinct measure, which is parsed once."""
    measures = stored(cands.select("label", "value", "uom").distinct().withColumn(
        "key", semantic_key(F.col("label"), F.col("value"), F.col("uom"))), "measures")
    numbers = stored(measures.select("key").distinct().withColumn("sk", F.monotonically_increasing_id()), "measure-keys")
    same = measures["key"]["k"].eqNullSafe(numbers["key"]["k"]) & measures["key"]["u"].eqNullSafe(numbers["key"]["u"])
    return stored(measures.join(numbers, same).select("label", "value", "uom", "sk"), "measure-ids")


def place(own: Column | None = None) -> Column:
    """The order of a label's candidates as one number: source priority, then normalized, then position."""
    return (F.col("kind") != "normalized" if own is None else own).cast("long") * F.lit(1 << 40) - F.col("priority").cast("long") * F.lit(1 << 42) + F.col("lineage")


def conflicts(cands: DataFrame, verdicts: DataFrame, missing: str | None = None) -> DataFrame:
    """Per label: `conflict`, `entailment` (of a label without a verdict: `missing`), whether the best sources disagree, the highest
    priority, and the `place` of the preferred candidate.  Reads `cands` twice; only numbers are shuffled."""
    m = measure_ids(cands).select(F.col("label").alias("__l"), F.col("value").alias("__v"), F.col("uom").alias("__u"), "sk")
    on = F.col("label").eqNullSafe(F.col("__l")) & F.col("value").eqNullSafe(F.col("__v")) & F.col("uom").eqNullSafe(F.col("__u"))
    keyed = cands.select(*LABEL, (F.col("kind") != "normalized").alias("own"), "lineage", "priority", "value", "uom").join(
        m, on).select(*LABEL, "own", "lineage", "priority", F.col("value").isNotNull().alias("filled"), "sk")
    own = lambda c: F.when(F.col("own"), F.col(c))
    # one shuffle: all three groupings lie inside a label
    dealt = keyed.repartition(*LABEL).withColumn("place", F.when(F.col("filled"), place(F.col("own"))))
    lineage = dealt.groupBy(*LABEL, "lineage").agg(
        F.min("sk").alias("lo"), F.max("sk").alias("hi"), F.min(own("sk")).alias("elo"), F.max(own("sk")).alias("ehi"),
        F.max(own("priority")).alias("prio"), F.min("place").alias("place"), F.max("priority").alias("top"))
    level = lineage.groupBy(*LABEL, "prio").agg(
        F.max(~F.col("lo").eqNullSafe(F.col("hi"))).alias("drift"), F.min("elo").alias("elo"), F.max("ehi").alias("ehi"),
        F.count("*").alias("n"), F.min("place").alias("place"), F.max("top").alias("top"))
    g = level.groupBy(*LABEL).agg(
        F.max("drift").alias("drift"), (~F.min("elo").eqNullSafe(F.max("ehi"))).alias("differ"), F.sum("n").alias("lineages"),
        F.max_by(~F.col("elo").eqNullSafe(F.col("ehi")), "prio").alias("top_conflict"), F.min("place").alias("place"), F.max("top").alias("top_priority"))
    v = verdicts.groupBy(*LABEL).agg(F.min_by("entailment", "idx").alias("entailment"))
    out = g.join(v, LABEL, "left").withColumn("entailment", F.coalesce("entailment", F.lit(missing)))
    weak = F.col("entailment").isNull() | F.col("entailment").isin("not_supported", "ambiguous")
    return out.select(*LABEL, (weak | F.col("drift") | F.col("differ")).alias("conflict"), "entailment",
                      ((F.col("lineages") > 1) & F.col("top_conflict")).alias("top_conflict"), "place", "top_priority")


def passthrough(cands: DataFrame, state: DataFrame) -> DataFrame:
    """The preferred candidate of each label without a conflict: by source priority, then normalized, then position."""
    calm = state.where(~F.col("conflict")).select(*LABEL, F.col("place").alias("__place"))
    return cands.join(calm, LABEL).where(F.col("value").isNotNull() & (place() == F.col("__place"))).select(*LABEL, *PICKED)


def decision_sets_match(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per item: every conflict label has exactly one decision and there are no others."""
    c = state.where("conflict").select(*LABEL, F.lit(1).alias("c"), F.lit(0).alias("d"))
    d = decisions.select(*LABEL, F.lit(0).alias("c"), F.lit(1).alias("d"))
    per = c.unionByName(d).groupBy(*LABEL).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    return per.groupBy("item_id").agg(F.min((F.col("c") == 1) & (F.col("d") == 1)).alias("labels_match"))


def _ids_ok() -> Column:
    sel = F.col("selected_candidate_id")
    rest = F.when(sel.isNull(), F.col("ids")).otherwise(F.array_remove("ids", F.coalesce(sel, F.lit(""))))
    said = F.array_sort(F.array_distinct("rejected_candidate_ids"))
    return F.coalesce((sel.isNull() | F.array_contains("ids", sel)) & (said == rest), F.lit(False))


def ids_partition(cands: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with `ids_ok`: selected and rejected ids are exactly the supplied ones."""
    supplied = cands.groupBy(*LABEL).agg(F.array_sort(F.collect_set("candidate_id")).alias("ids"))
    return decisions.join(supplied, LABEL, "left").withColumn("ids_ok", _ids_ok()).drop("ids")


def settle(cands: DataFrame, state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome per conflict label: id of the chosen candidate or NULL, review bit and reason.  Reads `state` and `decisions` twice."""
    hot = state.where("conflict")
    match = decision_sets_match(state, decisions).where("labels_match").select("item_id")
    usable = decisions.join(match, "item_id", "left_semi").select(*LABEL, "selected_candidate_id", "rejected_candidate_ids", "needs_human_review",
                                                                  "reasoning", F.lit(True).alias("given"))
    asked = hot.join(usable, LABEL, "left")
    # label by label: the supplied ids, the priority of the selected one, and the best of the highest priority
    names = [c for c in asked.columns if c not in LABEL]
    of_label = cands.select(*LABEL, "candidate_id", "priority", F.when(F.col("value").isNotNull(), place()).alias("at")).join(
        hot.select(*LABEL, "place", "top_priority"), LABEL).join(usable.select(*LABEL, "selected_candidate_id"), LABEL, "left")
    seen = of_label.groupBy(*LABEL).agg(
        F.array_sort(F.collect_set("candidate_id")).alias("ids"),
        F.max(F.when(F.col("candidate_id") == F.col("selected_candidate_id"), F.col("priority"))).alias("picked_priority"),
        F.max(F.when((F.col("at") == F.col("place")) & (F.col("priority") == F.col("top_priority")), F.col("candidate_id"))).alias("top_id"))
    rows = asked.join(seen, LABEL).select(*LABEL, *names, "picked_priority", "top_id", _ids_ok().alias("ids_ok"))
    picked = F.col("picked_priority").isNotNull()
    given, ok, ent = F.coalesce("given", F.lit(False)), F.coalesce("ids_ok", F.lit(False)), F.col("entailment")
    ambiguous = ent.isNull() | (ent == "ambiguous")
    unsupported = F.coalesce(ent == "not_supported", F.lit(False))
    kept = given & ok & picked & ~ambiguous & ~unsupported & ~F.col("top_conflict")
    lower = kept & (F.col("picked_priority") < F.col("top_priority"))
    chosen = F.when(lower, F.col("top_id")).when(kept, F.col("selected_candidate_id"))
    declined = given & ok & ~picked & ent.isin("supported", "partially_supported")
    review = (~given | (given & F.col("needs_human_review")) | (given & ~ok) | F.coalesce(declined, F.lit(False)) | ambiguous | F.col("top_conflict"))
    text = (F.when(~given, "Missing adjudication decision.")
            .when(~ok, "Adjudication response referenced an invalid or incomplete candidate set.").otherwise(F.col("reasoning")))
    reason = F.concat_ws(" ", text, F.when(ambiguous, "Ambiguous evidence requires human review.").when(unsupported, "Unsupported evidence was rejected."),
                         F.when(F.col("top_conflict"), "Top-priority sources conflict."),
                         F.when(lower, "Overridden by mandatory manufacturer-source priority."))
    return rows.select(*LABEL, chosen.alias("chosen_id"), review.alias("needs_review"), reason.alias("reason"), given.alias("decided"))


def rejected(cands: DataFrame, settled: DataFrame) -> DataFrame:
    """Every candidate of a conflict label that was not chosen, with the reason."""
    s = settled.select(*LABEL, F.col("chosen_id").alias("__id"), "reason")
    return cands.join(s, LABEL).where(~F.col("candidate_id").eqNullSafe(F.col("__id"))).select(
        *LABEL, "candidate_id", F.coalesce("value", F.lit("")).alias("value"), "reason", "source_type")


def final_attributes(cands: DataFrame, state: DataFrame, settled: DataFrame) -> DataFrame:
    """The preferred candidates of calm labels and the chosen ones of the others, in one pass over the candidates."""
    calm = state.where(~F.col("conflict")).select(*LABEL, F.col("place").alias("__place"), F.lit(None).cast("string").alias("__id"))
    won = settled.where(F.col("chosen_id").isNotNull()).select(*LABEL, F.lit(None).cast("long").alias("__place"), F.col("chosen_id").alias("__id"))
    mine = (F.col("value").isNotNull() & (place() == F.col("__place"))) | (F.col("candidate_id") == F.col("__id"))
    return cands.join(calm.unionByName(won), LABEL).where(F.coalesce(mine, F.lit(False))).select(*LABEL, *PICKED)
