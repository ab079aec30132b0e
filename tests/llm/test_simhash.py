import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestry.llm.components import components
from attestry.llm.simhash import SimHashParams, _keys, blocks_for, fingerprint, forest, links, near_duplicates, one_of_each

from oddrows import rows


def model(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """Smallest value reachable over distances up to the radius."""
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            low = min(label[b] for b in values if bin(a ^ b).count("1") <= radius)
            changed |= low < label[a]
            label[a] = min(label[a], low)
    return label


def planted(n=300):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2 ** 62, n)]
    for b in base[:60]:
        chain = b
        for _ in range(3):                      # chains whose ends are farther apart than the radius
            for bit in rng.choice(62, 3, replace=False):
                chain ^= 1 << int(bit)
            base.append(chain)
    return sorted(set(base))


def test_fingerprints():
    for _, text, *_ in rows()[:5] + rows()[6:11]:
        assert fingerprint(text) == model(text)
    from pyspark.sql import SparkSession  # the hash is the one Spark has built in
    spark = SparkSession.getActiveSession()
    if spark:
        assert spark.sql("select xxhash64('one two three')").first()[0] % 2 ** 64 == xxhash.xxh64_intdigest("one two three", seed=42)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_forest_connects_exactly(radius):
    values = planted(80)
    a, b = forest(np.array(values, np.uint64), radius)
    label = groups(values, radius)
    assert all(label[int(x)] == label[int(y)] for x, y in zip(a, b))
    assert len(a) == len(values) - len(set(label.values()))      # a spanning forest


@pytest.mark.parametrize("tile", [4096, 16, 4])
def test_links_over_buckets_and_tiles(spark, tile):
    values = planted()
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.component for r in components(links(df, SimHashParams(tile=tile))).collect()}
    label = groups(values, 3)
    assert {v: found.get(v, v) for v in values} == label


def test_keys_grow_with_the_data(spark):
    for n in (1, 10 ** 4, 10 ** 6, 10 ** 8, 10 ** 10):
        blocks, bits = blocks_for(n, 3, 4096)
        assert bits <= 64 // blocks * (blocks - 3)
        # any three flipped bits leave at least one key as it was
        rng = np.random.default_rng(n % 97)
        pairs = []
        for _ in range(50):
            v = w = int(rng.integers(0, 2 ** 62))
            for bit in rng.choice(62, 3, replace=False):
                w ^= 1 << int(bit)
            pairs.append((v, w))
        keys = lambda c: F.array(*_keys(blocks, 3, bits)) if c == "fp" else None
        df = spark.createDataFrame([(i, x) for i, p in enumerate(pairs) for x in p], "i int, fp long").select("i", F.posexplode(keys("fp")))
        assert df.groupBy("i", "pos", "col").count().where("count > 1").select("i").distinct().count() == len(pairs)


def test_odd_rows(odd, none):
    got = near_duplicates(odd).collect()
    ids = [r for r in rows()]
    assert sorted((str(r.doc_id), r.fp % 2 ** 64) for r in got) == sorted((str(i), fingerprint(t)) for i, t, *_ in ids)
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == 1 and by[4] == by[5] == by[3] == 3 and by[9] == 9 and by[None] is None
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(r.doc_id) for r in got if r.doc_id == r.component_id} | {"None"})
    assert near_duplicates(none).collect() == [] and one_of_each(none).collect() == []
