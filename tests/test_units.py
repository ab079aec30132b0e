from decimal import ROUND_HALF_UP, Decimal
from math import gcd

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from attestry.functions import units as un


def test_canonical_units(values):
    got = values(un.canonical_unit, ["volts", "Pounds", "degrees  F", "lb/in²", "furlong", '"', " ", None])
    assert got == ["V", "lb", "°F", "PSI", None, "in", None, None]


def test_split_measure(values):
    got = values(un.split_measure, [("24 in", None), ("24 in", "V"), ("24", "Inches"), ("24", "furlong"), ("5i", None), ("7 lbs", None), ("3 lb/in2", None)])
    assert [tuple(r) for r in got] == [("24", "in", True), ("24 in", None, False), ("24", "in", True), ("24", None, False),
                                       ("5", None, True), ("7 lbs", None, True), ("3", "PSI", True)]


def test_fraction_texts(values):
    got = values(un.fractions_in_text, ["24.25", "24.25 x 10.5", "0.015625", "v1.5 a.b", "-1.5", "no number", "50.1875"])
    assert got == ["24-1/4", "24-1/4 x 10-1/2", "1/64", "v1.5 a.b", "-1-1/2", "no number", "50-3/16"]


def model(text):
    d = Decimal(text)
    s = int((abs(d) * 64).quantize(Decimal(1), rounding=ROUND_HALF_UP))
    w, n = divmod(s, 64)
    body = str(w) if not n else (f"{w}-" if w else "") + f"{n // gcd(n, 64)}/{64 // gcd(n, 64)}"
    return ("-" if d < 0 else "") + body


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(-999, 999, places=6), min_size=50, max_size=100))
def test_fraction_model(spark, numbers):
    texts = [f"{n:.6f}" for n in numbers]
    rows = spark.createDataFrame([(x,) for x in texts], "a string").select("a", un.mixed_fraction(F.col("a")).alias("x")).collect()
    assert [(r["a"], r["x"]) for r in rows] == [(t, model(t)) for t in texts]
