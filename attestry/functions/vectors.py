"""Vector arithmetic as column functions over ARRAY<FLOAT/DOUBLE>."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    return let(v.cast("array<double>"), lambda w: let(
        F.greatest(F.sqrt(dot(w, w)), F.lit(floor)), lambda norm: F.transform(w, lambda x: x / norm)))
