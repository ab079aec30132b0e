"""Periodic runs against comparing every word with the one a period before it."""

import hashlib
import random
import zlib

import pytest
from attestry.llm.runs import COLUMNS, RunParams, SuffixTree, collapsed, find, word_runs

FOLDER = "/root/testdata/sf0.001"


def brute(words, least):
    """(start, period, end) of all runs, by start, then period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in best.items())


def model(text, doc_id, least=12, plant=True):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, least)
    top = min(found, key=lambda r: (r[0] - r[2], r[0], r[1]), default=None)
    drop = {i for s, q, e in found for i in range(s + q, e)}
    listed = "".join(f"{s},{e - s},{q}\n" for s, q, e in found)
    numbers = (None,) * 4 if top is None else (top[0], top[2] - top[0], top[1], 1000 * (top[2] - top[0]) // top[1])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *numbers, sha(listed.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(500):
        words = [b"%d" % rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randint(0, 60))]
        if words and rng.random() < 0.4:                        # a long run after something else
            words = (words[:rng.randint(0, len(words))] + words[:rng.randint(1, max(1, len(words) // 3))] * 6)[:80]
        for least in (2, 3, 6, 12):
            for covered in (True, False):                       # trees of repeated stretches, and of whole texts
                start, end, period = word_runs(words, RunParams(least, covered))
                assert list(zip(start.tolist(), period.tolist(), end.tolist())) == brute(words, least)


def test_common_prefixes():
    rng = random.Random(9)
    letters = [1 + rng.randrange(2) for _ in range(300)] + [1, 2] * 40
    tree, n = SuffixTree(letters), len(letters)
    import numpy as np

    i = np.array([rng.randrange(n) for _ in range(3000)])
    j = np.array([rng.randrange(n + 1) for _ in range(3000)])
    i, j = i[i != j], j[i != j]
    expect = []
    for a, b in zip(i.tolist(), j.tolist()):
        k = 0
        while max(a, b) + k < n and letters[a + k] == letters[b + k]:
            k += 1
        expect.append(k)
    assert tree.lce(i, j).tolist() == expect
    suffixes = sorted(range(n + 1), key=lambda s: letters[s:])
    assert [tree.rank[s] for s in suffixes] == list(range(n + 1))


def test_query_against_model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    short = {r.doc_id: r.text for r in docs.collect() if len((r.text or "").split()) < 700}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in find(docs, plant=True).collect()}
    assert len(got) == docs.count() and len(short) > 100
    assert {i: got[i] for i in short} == {i: model(t, i) for i, t in short.items()}
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_odd_rows(spark, odd, none):
    out = find(odd)
    assert out.columns == ["doc_id", *COLUMNS] and out.count() == odd.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[3].n_runs == by[4].n_runs == by[5].n_runs == 0 and by[3].start is None and by[3].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert (by[6].n_runs, by[6].start, by[6].length, by[6].period) == (1, 0, 300_000, 5)
    assert collapsed("x " + "a b c " * 5 + "y") == "x a b c y" and collapsed(None) == "" and collapsed("a b " * 5) == "a b " * 4 + "a b"
    assert find(none).collect() == []
