"""Texts that meet in a bucket by chance send no shingle sets."""

import random

from attestry.llm import nearcopies
from attestry.llm.nearcopies import NearParams, near_copies


def test_chance_meetings_send_no_sets(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    shared = [word() for _ in range(30)]
    texts = {i: " ".join([*shared, *[word() for _ in range(90)]]) for i in range(120)}
    texts |= {1000 + i: texts[i] + " " + word() for i in range(4)}
    kept, sent = nearcopies.stored, []

    def counted(df, name):
        out = kept(df, name)
        if name == "near-sets":
            sent.append(out.count())
        return out

    nearcopies.stored = counted
    try:
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.component_id for r in near_copies(df, NearParams(rows=1, bands=112)).collect()}     # short keys: nearly all texts meet
    finally:
        nearcopies.stored = kept
    assert got == {i: i % 1000 for i in texts}
    assert sum(sent) <= 16


def test_only_wanted_texts_are_shuffled(spark):
    """The hashes wanted pass the sieve, whatever its size, and few others do."""
    from pyspark.sql import functions as F

    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("key"))
    wanted = docs.where("doc_id % 50 = 0").select("key")
    for bits, most in ((2 ** 26, 2500), (2 ** 15, 2500), (1, 2500)):
        got = nearcopies._sieved(docs, "key", wanted, NearParams(sieve=bits))
        assert got.columns == ["doc_id", "key", "__maybe"] and got.count() == 20000
        assert got.where("doc_id % 50 = 0 and not __maybe").count() == 0
        assert got.where("__maybe").count() < most
    none = nearcopies._sieved(docs, "key", wanted.limit(0), NearParams())
    assert none.where("__maybe").count() == 0 and none.count() == 20000


def test_texts_that_stay_are_not_shuffled(spark):
    """No exchange lies between a row that nothing marks and the result."""
    texts = [(i, f"document {i} says " + " ".join(str(i * k) for k in range(2, 40)), "en", "web", 9) for i in range(300)]
    texts += [(1000 + i, texts[i][1] + " more", "en", "web", 9) for i in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = nearcopies.one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    plan = kept._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    branch = plan.children().head().toString()
    assert "Join LeftOuter" in branch and branch.count("Join") == 1 and "Window" not in branch
