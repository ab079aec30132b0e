"""The pipeline's near-copy stage links by SimHash too, and reads whole texts in one shuffle at its end."""

import corpus_pipeline
from attestry.llm import nearcopies
from attestry.llm.simhash import fingerprint

from oddrows import SCHEMA


def test_simhash_links_below_jaccard(spark):
    phrase = "one two three four five six seven " * 50
    texts = [phrase + "mail us on any day", phrase, "quite another text of some eight words here", None]
    assert bin(fingerprint(texts[0]) ^ fingerprint(texts[1])).count("1") <= 3
    assert nearcopies.jaccard(nearcopies.shingles(texts[0]), nearcopies.shingles(texts[1])) < 0.8
    columns = [f.split()[0] for f in SCHEMA.split(",")] if isinstance(SCHEMA, str) else SCHEMA.names
    row = lambda i, t: tuple({"doc_id": i, "text": t}.get(c) for c in columns)
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)] + [row(0, texts[0]), row(None, texts[2])], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "2", "3", "None"]
