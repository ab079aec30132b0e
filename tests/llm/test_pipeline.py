"""The pipeline's stages, each against plain Python on its own input."""

import collections
import re

import corpus_pipeline
import public_tokenizers
from attestry.llm.common import DOCUMENT
from attestry.llm.tokens import ChunkEncoder
from oddrows import rows
from test_nearcopies import groups

FOLDER = "/root/testdata/sf0.001"


def test_stages_feed_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        seen.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = seen[-1][1]
    for before, after in seen[:-1]:
        assert after.columns == DOCUMENT and set(map(str, after.schema)) == set(map(str, before.schema))
    tables = [(a.toPandas(), b.toPandas()) for a, b in seen]

    before, after = tables[0]                           # toxicity: rows go, none change
    assert set(after.doc_id) <= set(before.doc_id) and len(after) >= 0.8 * len(before)

    before, after = tables[1]                           # near copies: of each group at five-word Jaccard 0.8 the smallest id
    label = groups(dict(zip(before.doc_id, before.text)))
    assert sorted(after.doc_id) == sorted(set(label.values())) and len(after) < len(before)

    before, after = tables[2]                           # personal data: texts change, rows do not
    assert sorted(before.doc_id) == sorted(after.doc_id) and (after.n_chars == after.text.str.len()).all()
    mails = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    assert before.text.str.contains(mails).any() and not after.text.str.contains(mails).any()
    old = dict(zip(before.doc_id, before.text))
    assert all(t == old[i] for i, t in zip(after.doc_id, after.text) if "[" not in t)

    before, after = tables[3]                           # mixing: shares of words near their targets, at most three copies
    assert after.groupby("doc_id").size().max() <= 3
    size = lambda d: d.assign(n=[len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in d.text]).groupby("source").n.sum()
    assert abs(size(after).sum() - size(before).sum()) <= 0.1 * size(before).sum()

    before, after = tables[4]                           # packing: pieces of each row's ids
    encoder, ids = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for i, t in zip(before.doc_id, before.text):
        ids[i] += len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert after.groupby("doc_id").length.sum().to_dict() == dict(ids) and after.sequence_id.is_unique


def test_run_and_odd_rows(spark, odd, none):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for docs, least in ((odd, 1), (none, 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            assert (docs.count() >= least) if least else docs.count() == 0
    assert len(rows()) > 0
