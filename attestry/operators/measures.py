"""Measures are parsed once each: rows repeat few of them."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import stored


def with_parsed(rows: DataFrame, by: list[str], parsed: Column, name: str = "m") -> DataFrame:
    """Add `name`: the value of `parsed`, which reads the columns `by` only, worked out once per distinct combination of them.
    Nulls are values; no row is lost or repeated."""
    own = {c: f"__{c}" for c in by}
    known = stored(rows.select(*by).distinct().withColumn(name, parsed).withColumnsRenamed(own), "measures")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()])
    return rows.join(known, same).drop(*own.values())
