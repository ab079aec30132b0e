"""Near copies of the pipeline stage against brute-force Jaccard over five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from attestry.llm import nearcopies
from attestry.llm.common import DOCUMENT
from attestry.llm.nearcopies import NearParams, forest, jaccard, near_copies, one_of_each
from attestry.llm.simhash import fingerprint

from oddrows import SCHEMA, rows

FOLDER = "/root/testdata/sf0.001"


def model(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts):
    """Smallest id reachable over pairs at 0.8 or more."""
    sets, label = {i: model(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(i, k) for i in texts for k in texts if i < k and min(len(sets[i]), len(sets[k])) >= 0.8 * max(len(sets[i]), len(sets[k]))
             and similarity(sets[i], sets[k]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, k in links:
            low = min(label[i], label[k])
            changed |= label[i] != low or label[k] != low
            label[i] = label[k] = low
    return label


def planted():
    """Texts of 40 to 600 words with copies at similarities around and above 0.8, a chain, and a star whose copies are apart."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(80):
        words = [word() for _ in range(rng.choice((40, 100, 200, 600)))]
        texts.append(words)
        for share in (0.005, 0.01, 0.02, 0.025, 0.04):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, round(share * len(copy)))):
                copy[at] = word()
            texts.append(copy)
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(chain)
    star = [word() for _ in range(200)]
    for k in range(40):
        copy = list(star)
        for at in rng.sample(range(200), 4):
            copy[at] = word()
        texts.append(copy)
    texts.append(star)
    return dict(enumerate(" ".join(t) for t in texts))


@pytest.mark.parametrize("p", [NearParams(), NearParams(tile=8), NearParams(load=3000, deals=1), NearParams(rows=5, bands=36)])
def test_planted_pairs(spark, p):
    texts = planted()
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies(df, p).collect()}
    assert got == groups(texts)
    missed = [(i, k) for i in texts for k in range(i + 1, min(i + 6, len(texts))) if got[i] == got[k] and bin(fingerprint(texts[i]) ^ fingerprint(texts[k])).count("1") > 3]
    assert len(missed) > 100                # three bits do not reach these


def test_crowd_below_the_similarity_gives_no_rows(spark):
    """Pages of one template, far more alike than unrelated texts, give no rows in proportion to their pairs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    template = [word() for _ in range(160)]
    texts = {i: " ".join([*template[:80], *[word() for _ in range(34)], *template[80:]]) for i in range(300)}
    texts |= {1000 + i: t.replace(template[3], word()) for i, t in list(texts.items())[:5]}      # five real copies in it
    kept, written = nearcopies.stored, {}

    def counted(df, name):
        written[name] = (out := kept(df, name)).count()
        return out

    nearcopies.stored = counted
    try:
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.component_id for r in near_copies(df, NearParams(tile=64)).collect()}
    finally:
        nearcopies.stored = kept
    sample = similarity(model(texts[0]), model(texts[7]))
    assert 0.6 < sample < 0.75 and got == {i: i % 1000 for i in texts}
    assert written["near-links"] + written["near-more"] <= 2 * len(texts)


def test_forest_connects_what_pairs_connect():
    rng = random.Random(3)
    for _ in range(50):
        base = rng.sample(range(1000), 30)
        sets = [np.unique(np.array(base[rng.randint(0, 3):30 - rng.randint(0, 3)] + rng.sample(range(1000, 2000), rng.randint(0, 3)), np.uint64)) for _ in range(12)]
        sets.append(np.zeros(0, np.uint64))
        got = list(range(13))
        for i, k in forest(sets, np.arange(13), None, 0.8):
            got = [got[i] if g == got[k] else g for g in got]
        label = list(range(13))
        for i in range(13):
            for k in range(i):
                if jaccard(sets[i], sets[k]) >= 0.8:
                    label = [label[k] if g == label[i] else g for g in label]
        assert len({*zip(got, label)}) == len(set(got)) == len(set(label))


def test_rows_that_share_an_id(spark):
    """Two groups whose smallest id is the same keep a row each; a repeated row stays once."""
    a, b = "one two three four five six seven eight nine ten", "ten eleven twelve words of quite another kind are written here"
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, one_of_each(df).collect()), key=str) == sorted([(1, a), (1, b), (None, a)], key=str)


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    label = groups({r.doc_id: r.text for r in docs.collect()})
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == DOCUMENT and sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_odd_rows(spark, odd, none):
    by = {r.doc_id: r.component_id for r in near_copies(odd).collect()}
    assert by[4] == by[5] == by[3] == 3 and by[9] == 9 and by[None] is None
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and near_copies(odd).count() == len(rows())
    assert near_copies(none).collect() == [] and one_of_each(none).collect() == [] and none.schema.simpleString().count(":") == SCHEMA.count(",") + 1
