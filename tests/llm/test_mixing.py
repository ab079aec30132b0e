import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attestry.llm.mixing import mix, repeated

from oddrows import rows


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, stopped = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3.0 * sizes[s] for s in stopped}
        more = {s for s in free if want[s] > 3 * sizes[s]}
        if not more:
            return want
        stopped |= more


def check(docs, slack):
    got = mix(docs).collect()
    again = sorted(map(str, mix(docs.repartition(2)).collect()))
    assert sorted(map(str, got)) == again       # reruns agree, however rows are dealt
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.times * r.size
        assert 0 <= r.times <= 3 and (r.size > 0 or r.times == 0)
    want = targets(sizes)
    for r in got:
        assert r.source_target == pytest.approx(want[r.source], rel=1e-12) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= slack for s in sizes), (dict(taken), want)
    return got


def test_odd_rows(odd, none):
    got = check(odd, 240_000)                   # within the one very long text
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), count(t)) for i, t, *_ in rows())
    assert mix(none).collect() == [] and repeated(none).collect() == []


def test_many_sources(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
                                    F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    got = check(docs, 24)                       # a quarter of the longest text
    assert {r.times for r in got} >= {0, 1}
    out = repeated(docs.withColumn("times", F.lit("x")))
    assert out.columns == [*docs.columns, "times"] and out.count() == sum(r.times for r in got)


def test_unequal_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("a b c").alias("text"), (F.col("id") % 2 * 2 + 1).alias("w"))
    heavy = mix(docs, F.col("w")).groupBy("weight").agg(F.avg("times")).collect()
    assert {r[0]: round(r[1], 1) for r in heavy} == {1.0: 0.5, 3.0: 1.5}        # one sample for both, so each is near its share
