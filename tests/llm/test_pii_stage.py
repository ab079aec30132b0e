"""The pipeline's personal-data stage leaves nothing that op1's finder reports."""

import corpus_pipeline
from attestry.llm.pii import BASE, find
from pyspark.sql import functions as F

from oddrows import SCHEMA
from test_pii import TEXTS

FOLDER = "/root/testdata/sf0.001"
CASES = {"In order to reach us ring +44 20 7946 0958": "In order to reach us ring [PHONE]", "order +44 20 7946 0958": "order [PHONE]",
         "version 1.2.3.4": "version [IP]", "serial 4111 1111 1111 1111 ok": "serial [CARD] ok",
         "4111 1111 1111 1111 2.3.4.5": "[CARD] [IP]", "é order +49 30 1234567 x": "é order [PHONE] x", "plain": "plain"}


def left(df):
    return [(r.text, r.spans) for r in df.join(find(df), "doc_id").collect() if [s for s in r.spans if s.kind in BASE]]


def test_stage_leaves_no_base_span(spark):
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate([*CASES, *TEXTS])] + [(999, None, None, None, None)]
    out = corpus_pipeline.redact_personal_data(spark, spark.createDataFrame(rows, SCHEMA), FOLDER)
    got = {r.doc_id: r.text for r in out.collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values()) and got[999] is None and left(out) == []


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.withColumn("text", F.concat(F.lit("border conversion serially order version "), "text"))
    out = corpus_pipeline.redact_personal_data(spark, docs, FOLDER).cache()
    assert left(docs) and left(out) == [] and out.where("n_chars <> length(text)").count() == 0


def test_context_words_are_whole_words(spark):
    texts = ["at the border +44 20 7946 0958", "conversion 1.2.3.4", "serially +44 20 7946 0958", "in order to +44 20 7946 0958", "order +44 20 7946 0958"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.spans[0].score for r in find(df).orderBy("doc_id").collect()] == [0.6, 0.6, 0.6, 0.6, 0.3]
