"""The trained operators: language identification and toxicity, by held-out accuracy and brute-force segments."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oddrows import rows
from pyspark.sql import functions as F

from attestry.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.01"


def model_segments(scores):
    """Maximal scoring segments by recursion on the definition: the best segment, then both sides of it."""
    def cut(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return cut(a, i) + [(i, j, best[0])] + cut(j, b)
    return cut(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-8, 8).map(lambda x: x + 0.001), max_size=24))
def test_segments(scores):
    got = toxicity.segments(np.array(scores))
    assert [round(s, 6) for *_, s in got] == [round(s, 6) for *_, s in model_segments(scores)]
    assert all(abs(sum(scores[a:b]) - s) < 1e-9 for a, b, s in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_toxicity_held_out(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.detect(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    clean, bad = ([r for r in found if r.toxic == k] for k in (0, 1))
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean) and sum(r.predicted for r in bad) >= 0.5 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.85 < kept.count() / docs.count() < 1
    # odd rows, without and with labels that repeat, are null or name nothing
    some = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 0), (7, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for own in (some, labels.limit(0)):
        assert toxicity.detect(odd, own).count() == len(rows()) and toxicity.detect(none, own).count() == 0
        assert toxicity.without_toxic(odd, own).columns == odd.columns


def test_passages_lie_where_the_words_are(spark):
    docs = spark.createDataFrame([(i, " ".join(["calm"] * (i % 7 + 5) + (["awful", "awful"] if i % 5 == 0 else []) + ["words", "here"] * 4)) for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "int(doc_id % 5 = 0) as toxic")
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).collect():
        assert r.predicted == (r.doc_id % 5 == 0)
        assert [(p.start, p.end) for p in r.passages] == ([(r.doc_id % 7 + 5, r.doc_id % 7 + 7)] if r.doc_id % 5 == 0 else [])


def test_languages_held_out(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98 and np.mean([r.rejected for r in found]) < 0.05
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert langid.identify(odd).count() == len(rows())
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (3, 4, 5, 13)) and got[6].lang_pred in ("de", "en")
    assert langid.identify(none).collect() == []
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_strange_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs)
    strange = spark.createDataFrame([(1, "zzqx xqzz qqzx zxqq " * 20), (2, "日本語の文章です " * 20)], "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(strange, model).collect())


@pytest.mark.parametrize("bins", [64, 4096])
def test_gram_counts(bins):
    assert langid.grams("", bins).sum() == 1 and langid.grams("a1b", bins).shape == (bins,)
    assert (langid.grams("Ab  c", bins) == langid.grams("aB, C", bins)).all()
