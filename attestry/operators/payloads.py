"""Strict JSON payloads, status maps, templates and term lookup."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions.text import collapse
from attestry.operators import scanning


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 0.95, "high").when(c >= 0.80, "medium").otherwise("low")


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


_SHAPE = "OBJECT<label: STRING, source_excerpt: STRING, source_type: STRING, value: STRING>"


def check_candidates(df: DataFrame, payload: str) -> DataFrame:
    """Add `accepted` and, for accepted payloads, the typed candidate list.  The
    object must hold exactly `attributes`, each element exactly the four text
    fields, none empty, with a known source type."""
    v = F.try_parse_json(F.col(payload))
    outer = df.withColumn("__v", v).withColumn(
        "__items", F.try_variant_get("__v", "$.attributes", "array<variant>"))
    keys_ok = F.json_object_keys(F.col(payload)) == F.array(F.lit("attributes"))
    exact = F.forall("__items", lambda x: F.schema_of_variant(x) == F.lit(_SHAPE))
    checked = outer.withColumn("__exact", F.coalesce(
        F.col("__v").isNotNull() & keys_ok & F.col("__items").isNotNull() & exact, F.lit(False)))
    typed = checked.withColumn("__c", F.when(F.col("__exact"), F.try_variant_get(
        "__v", "$.attributes", "array<struct<label:string,value:string,source_excerpt:string,source_type:string>>")))
    good = F.forall("__c", lambda x: (F.length(x["label"]) > 0) & (F.length(x["value"]) > 0)
                    & (F.length(x["source_excerpt"]) > 0) & x["source_type"].isin(*fv.SOURCE_TYPES))
    accepted = F.coalesce(good, F.lit(False))
    return typed.select(*df.columns, accepted.alias("accepted"),
                        F.when(accepted, F.col("__c")).alias("candidates"))


def status_map(long: DataFrame, keys: list[str], field: str = "field", okay: str = "okay") -> DataFrame:
    """One MAP<STRING, BOOLEAN> per key from long status rows."""
    return long.groupBy(*keys).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(field, okay)))).alias("status"))


def render_status(df: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.withColumn("status", F.array_join(F.array_sort(entries), ","))


def fill_template(template: Column, values: Column) -> Column:
    """Replace every [Token] by its value, then collapse blanks."""
    filled = F.reduce(F.map_entries(values), template, lambda text, e: F.replace(
        text, F.concat(F.lit("["), e["key"], F.lit("]")), F.coalesce(e["value"], F.lit(""))))
    return collapse(filled)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every word, keeping the rest: the starts are
    split off with a zero-width pattern."""
    parts = F.split(c, r"\b(?=\w)")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def resolve_terms(inputs: DataFrame, terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """First term, in vocabulary order, whose name equals the input or one of whose
    synonyms occurs in it; otherwise a title-cased first-seen term."""
    raw = inputs.withColumn("raw", F.trim("raw")).withColumn("__l", F.lower("raw")).where(F.col("raw") != "")
    named = terms.withColumn("__l", F.lower("canonical"))
    direct = raw.join(named, "__l").select("input_id", "seq", F.lit(-1).alias("n"), "canonical", "state", "category")
    syn = synonyms.withColumn("__s", F.lower("synonym"))
    found = scanning.scan(raw, ["input_id"], "__l", syn, "__s", scanning.contained)
    indirect = (found.join(syn, F.col("key") == F.col("__s")).join(terms, "canonical")
                .select("input_id", "seq", F.col("syn_no").alias("n"), "canonical", "state", "category"))
    best = (direct.unionByName(indirect).groupBy("input_id")
            .agg(F.min_by(F.struct("canonical", "state", "category"), F.struct("seq", "n")).alias("hit")))
    return raw.join(best, "input_id", "left").select(
        "input_id", F.coalesce("hit.canonical", title_case(F.col("raw"))).alias("canonical"),
        F.coalesce("hit.state", F.lit("FIRST SEEN")).alias("state"),
        F.coalesce("hit.category", F.lit("DISCOVERED_CANDIDATE")).alias("category"))
