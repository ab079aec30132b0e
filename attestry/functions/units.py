"""Units of measure and decimal-to-fraction rules as column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions.text import casefold, collapse, let

_DECIMAL = r"(?<![\w./-])(-?\d+\.\d+)(?![\w.])"


def canonical_unit(c: Column) -> Column:
    pairs = [(spelling, unit) for unit, names in fv.UNITS.items() for spelling in {unit.lower(), *names}]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, casefold(collapse(c)))


def split_measure(value: Column, unit: Column) -> Column:
    """STRUCT(value, uom, valid): a trailing unit is split off; an unknown or
    contradicting explicit unit makes the measure invalid."""
    pattern = r"(?iuU)^(.*\d)\s*(" + fv.TRAILING_UNITS + ")$"

    def decide(x):
        text, explicit, tail_text, tail = x["text"], x["explicit"], x["tail_text"], x["tail"]
        has_tail = F.coalesce(tail_text != "", F.lit(False))
        unknown = F.coalesce((F.length(unit) > 0) & explicit.isNull(), F.lit(False))
        bad = unknown | (has_tail & explicit.isNotNull() & ~tail.eqNullSafe(explicit))
        return F.struct(
            F.when(has_tail & ~bad, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text).alias("value"),
            F.when(bad, F.lit(None)).when(has_tail, tail).otherwise(explicit).alias("uom"),
            (~bad).alias("valid"))

    # a value that ends in a digit other than 2 has no unit to split (lb/in2 ends in one)
    plain = F.right(value, F.lit(1)).isin(*"013456789")
    base = let(collapse(value), lambda text: let(
        F.when(plain, F.lit("")).otherwise(F.regexp_extract(text, pattern, 2)), lambda tail: F.struct(
            text.alias("text"), tail.alias("tail_text"), canonical_unit(tail).alias("tail"),
            canonical_unit(unit).alias("explicit"))))
    return let(base, decide)


def mixed_fraction(number: Column) -> Column:
    """Nearest 1/64, half up, reduced; the sign is kept.  The greatest common
    divisor with a power of two is the lowest set bit."""
    exact = number.cast("decimal(30,14)")
    scaled = F.floor(F.abs(exact) * F.lit(64) + F.lit("0.5").cast("decimal(2,1)")).cast("bigint")

    def text(s):
        whole, num = F.shiftright(s, 6), s.bitwiseAND(F.lit(63).cast("bigint"))
        # the divisor is zero only for a zero numerator, where it is not used
        return let(F.greatest(num.bitwiseAND(-num), F.lit(1).cast("bigint")), lambda div: (
            F.when(num == 0, whole.cast("string")).otherwise(F.concat(
                F.when(whole > 0, F.concat(whole.cast("string"), F.lit("-"))).otherwise(F.lit("")),
                (num / div).cast("bigint").cast("string"), F.lit("/"),
                (F.lit(64) / div).cast("bigint").cast("string")))))

    return F.concat(F.when(exact < 0, F.lit("-")).otherwise(F.lit("")), let(scaled, text))


def fractions_in_text(text: Column) -> Column:
    """Rewrite every standalone decimal: split around the matches, convert the
    matches, and zip the two lists back together."""
    pattern = "(?U)" + _DECIMAL
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    between = F.split(text, pattern, -1)
    joined = F.zip_with(between, F.transform(found, mixed_fraction),
                        lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains(".") & text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def format_measure(value: Column, unit: Column) -> Column:
    return F.when(F.length(unit) > 0, F.concat(value, F.lit(" "), unit)).otherwise(value)


def normalize_measure(label: Column, value: Column, unit: Column) -> Column:
    """STRUCT(value, uom, valid) after the unit split and, for lengths or
    dimension labels, the fraction rule."""
    dimension = F.lit(False)
    for word in fv.DIMENSION_WORDS:
        dimension = dimension | casefold(label).contains(word)

    def finish(m):
        as_fraction = F.coalesce(m["uom"].isin("in", "ft"), F.lit(False)) | dimension
        return F.struct(
            F.when(as_fraction, fractions_in_text(m["value"])).otherwise(m["value"]).alias("value"),
            m["uom"].alias("uom"), m["valid"].alias("valid"))

    nothing = F.struct(F.lit("").alias("value"), F.lit(None).cast("string").alias("uom"), F.lit(False).alias("valid"))
    return F.when(value.isNull(), nothing).otherwise(let(split_measure(value, unit), finish))
