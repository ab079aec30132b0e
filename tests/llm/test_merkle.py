"""Merkle manifest against a plain recursive tree."""

import hashlib
import zlib

import pytest
from attestry.llm import merkle, queries
from attestry.llm.merkle import FIELDS, MerkleParams
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """Root of (name, digest) nodes, and each name's (before, after) up to it."""
    paths, level = {name: [] for name, _ in nodes}, [([name], d) for name, d in nodes]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for k, (names, _) in enumerate(run):
                for name in names:
                    paths[name].append(("".join(d for _, d in run[:k]), "".join(d for _, d in run[k + 1:])))
            above.append(([n for names, _ in run for n in names], digest(*[d for _, d in run])))
        level = above
    return level[0][1], paths


def model(rows, fanout=3, seen=None):
    """(doc_id, leaf, seen, subroot, root, path) of rows of FIELDS."""
    rows = [(r, leaf(r), leaf(seen(r)) if seen else leaf(r)) for r in rows]
    rows.sort(key=lambda r: (r[0][1] is not None, (r[0][1] or "").encode(), r[0][0] is not None, r[0][0] or 0, r[1]))
    sources = list(dict.fromkeys(r[0][1] for r in rows))
    trees = {s: tree([(i, r[1]) for i, r in enumerate(rows) if r[0][1] == s], fanout) for s in sources}
    root, tops = tree([(s, trees[s][0]) for s in sources], fanout)
    return [(r[0][0], r[1], r[2], trees[r[0][1]][0], root, trees[r[0][1]][1][i] + tops[r[0][1]]) for i, r in enumerate(rows)]


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1], r[5]))


@pytest.mark.parametrize("fanout,rows", [(3, 100_000), (2, 7), (5, 3)])
def test_manifest(spark, odd, fanout, rows):
    found = merkle.manifest(odd, MerkleParams(fanout, rows))
    got = [(r.doc_id, r.leaf, r.seen, r.subroot, r.root, [tuple(x) for x in r.path]) for r in found.collect()]
    assert sorted_rows(got) == sorted_rows(model([tuple(r) for r in odd.select(*FIELDS).collect()], fanout))
    assert all(r.verified for r in merkle.verified(found).collect())


def test_single_and_empty(spark, odd, none):
    one = merkle.manifest(odd.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == []
    assert merkle.manifest(none).collect() == [] and merkle.verified(merkle.manifest(none)).columns[-1] == "verified"


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*FIELDS)
    rows = [tuple(r) for r in docs.collect()]
    tampered = lambda r: (*r[:4], r[4].replace("\n", "") if zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None else r[4])
    expect = {}
    for i, own, seen, subroot, root, path in model(rows, seen=tampered):
        folded = seen
        for before, after in path:
            folded = digest(before, folded, after)
        expect[i] = (own, subroot, root, digest(*["".join(x) for x in path]), folded, folded == root)
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_merkle"](spark, FOLDER).collect()}
    assert got == expect and {v[-1] for v in got.values()} == {True, False}


def test_no_source_in_one_task(spark):
    """One source has all rows; its numbering is dealt over partitions and still without gaps."""
    df = spark.range(1000).select("id", F.lit("a").alias("g"), (F.col("id") % 7).alias("o"))
    out = merkle.numbered(df, "g", ["o", "id"], MerkleParams(rows=50))
    rows = [r.id for r in out.orderBy("k").collect()]
    assert rows == sorted(range(1000), key=lambda i: (i % 7, i)) and {r.size for r in out.collect()} == {1000}
    assert out.select(F.spark_partition_id()).distinct().count() > 1
