"""Catalog cleaning: six text columns, nulled placeholders, and their profile."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as tx

FIELDS = ("mfg_part_num", "part_desc", "e1_brand", "unilog_brand", "dib_brand", "part_manuf")


def clean_catalog(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Replace each field by its cleaned value, placeholders by NULL, and list the
    fields that held a placeholder (a missing input is not a placeholder)."""
    def both(x):
        return F.struct(F.when(~tx.is_placeholder(x), x).alias("v"), tx.is_placeholder(x).alias("p"))

    rest = [c for c in df.columns if c not in fields]
    cleaned = df.select(*rest, *[F.when(F.col(f).isNotNull(), F.lit(f)).alias(f"__{f}") for f in fields],
                        *[tx.let(tx.clean_text(F.col(f)), both).alias(f) for f in fields])
    nulled = F.array_compact(F.array(*[F.when(F.col(f"{f}.p"), F.col(f"__{f}")) for f in fields]))
    return cleaned.select(*rest, *[F.col(f"{f}.v").alias(f) for f in fields], nulled.alias("nullified_fields"))


def placeholder_profile(cleaned: DataFrame) -> DataFrame:
    """How many values were nulled in each column."""
    return (cleaned.select(F.explode("nullified_fields").alias("field"))
            .groupBy("field").agg(F.count("*").alias("nulled")))


def mostly_placeholder_columns(df: DataFrame, order: str, fields: tuple[str, ...] = FIELDS,
                               rows: int = 20, share: float = 0.6) -> DataFrame:
    """Columns whose leading rows are mostly placeholders (a preview: `rows` is the feature)."""
    head = df.orderBy(order).limit(rows)
    flags = head.select(*[
        tx.is_placeholder(tx.clean_text(F.col(f))).cast("int").alias(f) for f in fields])
    return (flags.unpivot([], list(fields), "field", "flag").groupBy("field")
            .agg(F.sum("flag").cast("bigint").alias("placeholders"), F.count("*").alias("rows"))
            .withColumn("mostly_placeholder", F.col("placeholders") / F.col("rows") > share))
