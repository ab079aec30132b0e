"""Cosine of given pairs: terms are found once, and shared terms only are joined."""

import math

from pyspark.sql import functions as F

from attestry.operators.matching import pair_cosine


def test_terms_are_found_once_and_cosine_is_right(spark):
    docs = {1: ["pump", "valve"], 2: ["pump", "seal"], 3: ["seal"], 4: [None], 5: []}
    table = spark.createDataFrame([(d, " ".join(w or "" for w in words)) for d, words in docs.items()], "doc_id long, text string")
    terms = table.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("term"))
    terms = terms.union(terms).union(spark.createDataFrame([(4, None)], "doc_id long, term string"))
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (1, 3)], "left_id long, right_id long")
    got = pair_cosine(terms, pairs)
    assert "regexp_extract_all" not in got._jdf.queryExecution().analyzed().toString()
    w = lambda df: math.log(5 / (df + 1)) + 1
    norm = {1: math.hypot(w(2), w(1)), 2: math.hypot(w(2), w(2)), 3: w(2)}
    want = {(1, 2): w(2) ** 2 / (norm[1] * norm[2]), (2, 3): w(2) ** 2 / (norm[2] * norm[3]), (3, 4): 0, (4, 5): 0, (1, 3): 0}
    rows = {(r.left_id, r.right_id): r.cosine for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-9 for k in want)
