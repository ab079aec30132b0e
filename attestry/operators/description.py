"""Length-limited descriptions from a fixed label order, and their compliance."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions import text as tx
from attestry.functions.units import format_measure
from attestry.params import DEFAULTS

DEFAULT_LIMITS = {"MOBILE_DESC": 80, "INVOICE_DESC": 40, "SHORT_DESC": 115, "LONG_DESC1": 405, "RETAIL_DESC": 75}


def compact(label: Column, value: Column, uom: Column) -> Column:
    out = F.when(label == "Number of Wash Cycles", value).otherwise(
        F.upper(F.replace(format_measure(value, uom), F.lit(" "), F.lit(""))))
    for spelled, short in fv.VALUE_ABBREVIATIONS.items():
        out = F.when(tx.casefold(value) == spelled, short).otherwise(out)
    return F.when(value.isNull(), "").otherwise(out)


def phrase(label: Column, value: Column, uom: Column, style: str) -> Column:
    v = format_measure(value, uom)
    cycles = F.lit("-Wash Cycle" if style in ("short", "retail") else " Wash Cycles")
    return F.when(value.isNull(), "").otherwise(
        F.when(label.isin("Series", "Material", "Color", "Size"), v)
        .when(label == "Number of Wash Cycles", F.concat(v, cycles))
        .when(label == "Mounting Type", F.concat(v, F.lit(" Mounting")))
        .when(label == "Additional Information", F.concat(F.lit("Additional Information: "), v))
        .otherwise(F.concat(v, F.lit(" "), label)))


def join_within(parts: Column, sep: str, limit: int) -> Column:
    """STRUCT(text, truncated): parts joined while they fit.  A part that does not fit
    is skipped and a later, shorter one may still be taken; when none fits, the
    first part is cut."""
    useful = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 0)

    def add(acc, p):
        longer = F.when(acc["text"] == "", p).otherwise(F.concat(acc["text"], F.lit(sep), p))
        return F.when(F.length(longer) <= limit, F.struct(longer.alias("text"), acc["truncated"].alias("truncated"))).otherwise(
            F.struct(acc["text"].alias("text"), F.lit(True).alias("truncated")))

    def close(u):
        joined = F.aggregate(u, F.struct(F.lit("").alias("text"), F.lit(False).alias("truncated")), add)
        first = F.coalesce(F.get(u, 0), F.lit(""))
        return tx.let(joined, lambda j: F.when(j["text"] != "", j).otherwise(F.struct(
            F.rtrim(F.left(first, F.lit(limit))).alias("text"), (F.length(first) > limit).alias("truncated"))))

    return tx.let(useful, close)


def with_attribute_map(items: DataFrame, attrs: DataFrame) -> DataFrame:
    """Items with MAP<label, STRUCT<value, uom>>; one entry per label of an item."""
    one = attrs.where(F.col("value").isNotNull()).groupBy("item_id", "label").agg(F.max(F.struct("value", "uom")).alias("a"))
    m = one.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "a"))).alias("attrs"))
    return items.join(m, "item_id", "left")


def build(items: DataFrame, limits: dict[str, int] = DEFAULT_LIMITS, target: int = DEFAULTS.mobile_target) -> DataFrame:
    """Five description fields with flags and per-field compliance.  Expects product_name,
    brand, manufacturer, mpn and the attribute map."""
    at = lambda label: F.try_element_at("attrs", F.lit(label))
    say = lambda label, style: phrase(F.lit(label), at(label)["value"], at(label)["uom"], style)
    brief = lambda label: compact(F.lit(label), at(label)["value"], at(label)["uom"])
    series, name, brand, maker = at("Series")["value"], F.col("product_name"), F.col("brand"), F.col("manufacturer")
    differs = tx.entity_key(maker) != tx.entity_key(brand)
    identity = F.when(differs, F.concat_ws(" ", maker, brand)).otherwise(F.coalesce(brand, maker))
    tail = F.when(at("Number of Wash Cycles").isNotNull(), brief("Depth With Door Open")).otherwise(brief("Sound Level"))
    join = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: F.length(x) > 0), " ")
    parts = {
        "MOBILE_DESC": (F.array(identity, name, series, F.col("mpn"), say("Mounting Type", "mobile")), ", "),
        "INVOICE_DESC": (F.array(F.upper(name), *[brief(x) for x in fv.INVOICE_ORDER], tail), " "),
        "SHORT_DESC": (F.array(join(brand, series, F.col("mpn"), name), *[say(x, "short") for x in fv.SHORT_ORDER]), ", "),
        "LONG_DESC1": (F.array(join(brand, name), series, *[say(x, "long") for x in fv.LONG_ORDER]), ", "),
        "RETAIL_DESC": (F.array(join(series, name), *[say(x, "retail") for x in fv.SHORT_ORDER]), ", "),
    }
    made = items.select("*", *[join_within(p, sep, limits[f]).alias(f"__{f}") for f, (p, sep) in parts.items()])
    text = {f: F.nullif(F.col(f"__{f}.text"), F.lit("")) for f in parts}
    floor = lambda f: F.length(text[f]) >= (target if f == "MOBILE_DESC" else 0)
    okay = {f: F.coalesce(floor(f) & (F.length(text[f]) <= limits[f]), F.lit(False)) for f in parts}
    flag = lambda cond, code, field: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    flags = F.array_compact(F.array(
        flag(name.isNull(), "description_missing_product_name", "Product Name"),
        *[flag(F.col(f"__{f}.truncated"), "description_truncated", f) for f in parts],
        flag(F.length(text["MOBILE_DESC"]) < target, "mobile_description_below_target", "MOBILE_DESC")))
    return made.select(*items.columns, *[text[f].alias(f) for f in parts], F.lit(None).cast("string").alias("MARKETING_DESCRIPTION"),
                       F.create_map(*[x for f in parts for x in (F.lit(f), okay[f])], F.lit("MARKETING_DESCRIPTION"), F.lit(False)).alias("compliance"),
                       flags.alias("desc_flags"))


def fields() -> Column:
    """ARRAY<STRUCT(field, value, compliant)> of a described row."""
    return F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f).alias("value"), F.coalesce(F.try_element_at("compliance", F.lit(f)), F.lit(False)).alias("compliant"))
        for f in fv.DESCRIPTION_FIELDS])


def field_rows(described: DataFrame) -> DataFrame:
    """Long (item_id, field, value, compliant) rows for the audit."""
    return described.select("item_id", F.inline(fields()))
