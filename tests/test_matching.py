"""Brute-force models for the joins that avoid comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import similarity as sim
from attestry.functions import text as tx
from attestry.operators import attributes as at
from attestry.operators import entities as en
from attestry.operators import evidence as ev
from attestry.operators import taxonomy as tax
from attestry.operators.matching import contains_join
from attestry.operators.namesearch import NameIndex, PathIndex
from attestry.operators.scanning import near_mentions


def words(rng, n, alphabet="abc", lo=1, hi=9):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi))) for _ in range(n)]


def mutate(rng, s, edits):
    for _ in range(edits):
        i = rng.randrange(len(s))
        s = s[:i] + (rng.choice("xyz") if rng.random() < .5 else "") + s[i + rng.randint(0, 1):]
    return s or "q"


def test_native_ratio_equals_helper(spark):
    rng = random.Random(1)
    pairs = list(zip(words(rng, 60), words(rng, 60)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.indel(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r["r"] - sim.ratio(r["a"], r["b"])) < 1e-9 for r in rows)


def test_partial_windows():
    def brute(a, b):
        s, t = sorted((a, b), key=len)
        spans = [t[max(0, i):i + len(s)] for i in range(1 - len(s), len(t))]
        best = max(sim.ratio(s, w) for w in spans if w)
        return max(best, max(sim.ratio(t, w) for w in [s[max(0, i):i + len(t)] for i in range(1 - len(t), len(s))] if w)) if len(a) == len(b) else best

    rng = random.Random(2)
    for a, b in zip(words(rng, 300), words(rng, 300, hi=14)):
        assert sim.partial(a, b) == pytest.approx(brute(a, b))


@pytest.mark.parametrize("chunk, sent", [(20_000, 8), (10, 8), (10, 2)])
def test_contains_join(spark, chunk, sent):
    """One chunk of keys, several sent with the tasks, and several in groups of their own."""
    rng = random.Random(3)
    texts, keys = words(rng, 80, "abcd", 1, 40), list(set(words(rng, 60, "abcd", 1, 7)))
    got = contains_join(spark.createDataFrame([(x,) for x in texts], "t string"), "t",
                        spark.createDataFrame([(k,) for k in [*keys, "", None]], "k string"), "k", chunk, sent).collect()
    assert sorted((r["t"], r["k"]) for r in got) == sorted({(x, k) for x in texts for k in keys if k in x})
    none = spark.createDataFrame([], "k string")
    assert contains_join(spark.createDataFrame([("ab",), (None,)], "t string"), "t", none, "k").collect() == []


def named_texts(rng):
    """Names, and texts that hold them with none to many misspellings, cut at either end, or nothing of them."""
    name = lambda: " ".join(words(rng, rng.randint(1, 4), "abcdefgh", 2, 8))
    keys = sorted({name() for _ in range(40)} | {"ab", "a", "x" * 70})
    texts = []
    for _ in range(150):
        k = rng.choice(keys)
        texts.append(" ".join([*words(rng, rng.randint(0, 25), "abcdefgh", 2, 8), mutate(rng, k, rng.randint(0, 1 + len(k) // 6)), *words(rng, rng.randint(0, 25), "abcdefgh", 2, 8)]))
    texts += [t[:rng.randint(1, len(t))] for t in texts[:40]] + [k[1:] for k in keys] + keys
    return keys, texts


@pytest.mark.parametrize("chunk, sent", [(20_000, 8), (9, 8), (9, 2)])
@pytest.mark.parametrize("least", [86.0, 92.0])
def test_near_mentions_against_every_window(spark, least, chunk, sent):
    keys, texts = named_texts(random.Random(int(least)))
    rows = [(i, t) for i, t in enumerate([*texts, "", None])]
    got = near_mentions(spark.createDataFrame(rows, "id int, t string").repartition(3), ["id"], "t", spark.createDataFrame([(k,) for k in keys], "k string"), "k", least, chunk, sent)
    want = {(i, k): s for i, t in rows if t for k in keys if (s := sim.partial(k, t)) >= least - 1e-9}
    got = {(r["id"], r["key"]): r["score"] for r in got.collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert sum(s < 100 for s in want.values()) > 25


def test_mentioned_manufacturer(spark):
    """A paired brand first, then the best score, contained names at 0.93, near ones up to 0.93, none below 0.86."""
    vocab = lambda *names: spark.createDataFrame([(n.lower(), n) for n in names], "key string, canonical_name string")
    texts = ["all about acme tools today", "northern lights kompany of the north", "northern lights company and zeta motors", "xxorthern lixxts comxxny", None, "northern lights comp"]
    e = spark.createDataFrame(list(enumerate(texts)), "id int, evidence_key string")
    out = ev.mentioned_manufacturer(e, vocab("Acme Tools", "Unpaired"), vocab("Northern Lights Company", "Zeta Motors"),
                                    spark.createDataFrame([("acme tools", "Acme Holding")], "brand_key string, manufacturer string"), "id")
    got = {r["id"]: (r["manufacturer"], r["confidence"] and round(r["confidence"], 4)) for r in out.collect()}
    assert got == {0: ("Acme Holding", 0.95), 1: ("Northern Lights Company", 0.93), 2: ("Zeta Motors", 0.93), 3: (None, None), 4: (None, None), 5: ("Northern Lights Company", 0.93)}


def test_near_keys_finds_every_pair(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "z" for n in (8, 13, 20, 25, 30, 34, 35, 36, 40, 50, 60) for _ in range(4)]
    keys = sorted({*base, *[mutate(rng, b, e) for b in base for e in (1, 1, 2, 3)]})
    want = {(a, b): sim.ratio(a, b) for a in keys for b in keys if a < b and sim.ratio(a, b) >= 96}
    got = {(r["a"], r["b"]): r["score"] for r in en.near_keys(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_clusters_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (14, 18, 22, 26) for _ in range(3)]
    names = [m for b in base for m in (b, b.upper(), mutate(rng, b, 1), mutate(rng, b, 1), mutate(rng, mutate(rng, b, 1), 1))]
    rows = [(v, rng.randint(1, 5)) for v in sorted(set(names))]
    df = spark.createDataFrame(rows, "value string, n bigint").withColumn("key", F.lower("value"))
    got = {r["value"]: r["leader"] for r in en.assign_leaders(df).collect()}
    leaders, want = [], {}
    for v, _ in sorted(rows, key=lambda x: (-x[1], x[0].casefold(), x[0])):
        scored = [(sim.ratio(v.lower(), k), -i) for i, k in enumerate(leaders) if sim.ratio(v.lower(), k) >= 96]
        if scored:
            want[v] = leaders[-max(scored)[1]]
        else:
            leaders.append(v.lower())
            want[v] = v.lower()
    assert got == want and len(set(want.values())) < len(want)


def company_names(rng, n):
    first = words(rng, 400, "abcdefghijklmnoprstuvwyz", 3, 10)
    return sorted({" ".join(rng.choice(first) for _ in range(rng.choice((1, 2, 2, 3, 4)))) + rng.choice(("", " tools", " brand 7", " tools tools")) for _ in range(n)})


def test_name_bounds_hold():
    rng = random.Random(11)
    names = company_names(rng, 300) + sorted(set(words(rng, 100, "abc ", 1, 30)) - {""})
    names = sorted({" ".join(x.split()) for x in names} - {""})
    index = NameIndex(names)
    for q in [*rng.sample(names, 60), *[mutate(rng, x, 2) for x in rng.sample(names, 60)]]:
        q = " ".join(q.split()) or "q"
        bound = index.bounds(q)
        sharp = index.bounds(q, np.arange(len(names)))
        assert all(sim.composite(q, k) <= min(b, s) + 1e-9 for k, b, s in zip(names, bound, sharp))


@pytest.mark.parametrize("chunk, sent", [(20_000, 8), (40, 8), (40, 2)])
def test_rank_names_equals_all_pairs(spark, chunk, sent):
    """One chunk of entries, several sent with the tasks, several in groups of their own."""
    rng = random.Random(6)
    names = company_names(rng, 150)
    asked = sorted({" ".join(mutate(rng, rng.choice(names), rng.randint(0, 3)).split()) for _ in range(80)} - {""})
    e = spark.createDataFrame([(k, k.title()) for k in names], "key string, canonical_name string")
    got = en.rank_names(spark.createDataFrame([(a,) for a in asked], "key string"), e, 3, chunk, sent).collect()
    for q in asked:
        top = sorted((-sim.composite(q, k) / 100, k.title().casefold(), k.title()) for k in names)[:3]
        assert [(-r["score"], r["canonical_name"]) for r in sorted(got, key=lambda r: r["rank"]) if r["key"] == q] == [(s, n) for s, _, n in top]


def test_few_names_are_scored():
    """Near names of a large vocabulary are found by scoring a small share of it."""
    rng = random.Random(12)
    names = company_names(rng, 5000)
    index = NameIndex(names)
    asked = [" ".join(mutate(rng, x, 1).split()) for x in rng.sample(names, 100)]
    for q in asked:
        index.top(q, 3)
    assert index.scored < 0.02 * len(names) * len(asked)


def test_constrain_against_brute_force(spark):
    rng = random.Random(7)
    bucket = sorted(set(words(rng, 25, "ab c", 2, 14)))
    asked = sorted({mutate(rng, b, 1) for b in bucket} | set(words(rng, 25, "ab c", 1, 20)) | set(bucket))
    key = lambda s: " ".join(s.split())
    vocab = spark.createDataFrame([("P", "L", b, None, i) for i, b in enumerate(bucket) if key(b)], "classpath string, label string, value string, uom string, seq bigint")
    vals = spark.createDataFrame([("P", "L", a, None, True, i) for i, a in enumerate(asked)], "classpath string, label string, value string, uom string, valid boolean, ord bigint")
    closed = spark.createDataFrame([], "classpath string, label string")
    got = {r["value"]: (r["match_value"], round(r["score"], 9)) for r in at.constrain(vals, vocab, closed, ["ord"]).collect()}
    want = {}
    for a in asked:
        if not key(a):
            continue
        s, i = max((sim.composite(key(a), key(b)), -i) for i, b in enumerate(bucket) if key(b))
        if s >= 90:
            want[a] = (bucket[-i], round(s / 100, 9))
    assert got == want and any(s < 1 for _, s in want.values())


def test_nearest_path_prefers_exact(spark):
    have = spark.createDataFrame([("A>B>Drill",), ("A>B>Hand saw",)], "path string")
    want = spark.createDataFrame([("A>B>Drill",), ("X>Hand saws",), ("Qqq>Zzz",)], "classpath string")
    got = {r["classpath"]: r["path"] for r in tax.nearest_path(want, have, 80).collect()}
    assert got == {"A>B>Drill": "A>B>Drill", "X>Hand saws": "A>B>Hand saw"}


@pytest.mark.parametrize("chunk, sent", [(20_000, 8), (20, 8), (20, 2)])
def test_nearest_path_equals_all_pairs(spark, chunk, sent):
    """The cutoff of 55 and ties in path order included."""
    rng = random.Random(13)
    part = lambda: " ".join(words(rng, rng.randint(1, 3), "abcdefghij", 2, 8))
    tops = [part() for _ in range(6)]
    have = sorted({">".join([rng.choice(tops), rng.choice(tops), part()]) for _ in range(120)} | {"single", "a>b", "x>" + "y" * 70})
    asked = sorted({rng.choice((h, mutate(rng, h, 2), h.rsplit(">", 1)[-1], "zz>" + mutate(rng, h.rsplit(">", 1)[-1], 1), part(), "9>88>777")) for h in have})
    got = {r["classpath"]: (r["path"], r["score"]) for r in tax.nearest_path(
        spark.createDataFrame([(a,) for a in asked], "classpath string"), spark.createDataFrame([(h,) for h in have], "path string"), 55, chunk, sent).collect()}
    want = {}
    for a in asked:
        score, path = min((-sim.category(a, h), h) for h in have) if a not in have else (-100.0, a)
        if score <= -55:
            want[a] = (path, -score)
    assert got == want and 20 < len(want) < len(asked)


def test_few_paths_are_scored():
    rng = random.Random(14)
    part = lambda: " ".join(words(rng, rng.randint(1, 3), "abcdefghijklmnop", 3, 9))
    tops, leaves = [part() for _ in range(30)], [part() for _ in range(600)]
    have = sorted({">".join([rng.choice(tops), rng.choice(tops), rng.choice(leaves)]) for _ in range(4000)})
    index = PathIndex(have)
    for n, path in enumerate(rng.sample(have, 40)):
        query = "other>" + mutate(rng, path.rsplit(">", 1)[-1], 1)
        (at, score), = index.top(query, 1)
        assert n > 2 or (-score, have[at]) == min((-sim.category(query, h), h) for h in have)
    assert index.scored < 0.02 * 40 * len(have)


def test_constrain_returns_every_match(spark):
    """Against the scorer over all pairs of a bucket and unit, near matches included."""
    rng = random.Random(9)
    base = ["stainless steel", "painted black steel", "built in", "leg mount", "energy star rated", "glass and wood", "12 in wide frame"]
    vocabulary = [(f"P{i % 2}", "L", v, None, i) for i, v in enumerate(base)]
    asked = {(f"P{i % 3}", rng.choice([v, v.upper(), " ".join(reversed(v.split())), mutate(rng, v, rng.randint(1, 3)), v + " x"])) for i, v in enumerate(base * 12)}
    rows = [(p, "L", v, None, True, i, 0) for i, (p, v) in enumerate(sorted(asked))]
    closed = spark.createDataFrame([("P2", "L")], "classpath string, label string")
    got = at.constrain(spark.createDataFrame(rows, "classpath string, label string, value string, uom string, valid boolean, item_id bigint, idx int"),
                       spark.createDataFrame(vocabulary, "classpath string, label string, value string, uom string, seq bigint"), closed, ["item_id", "idx"]).collect()
    key = lambda v: spark.createDataFrame([(v,)], "v string").select(tx.comparison_key(F.col("v"))).first()[0]
    keys = {v: key(v) for v in {*base, *[v for _, v in asked]}}
    want = {}
    for path, _, value, *_ in rows:
        scored = [(-(100.0 if keys[value] == keys[v] else sim.composite(keys[value], keys[v])) / 100, seq, v) for p, _, v, _, seq in vocabulary if p == path]
        best = min(scored, default=None)
        if best and -best[0] >= 0.9:
            want[path, value] = (best[2], round(-best[0], 9))
    assert {(r.classpath, r.value): (r.match_value, round(r.score, 9)) for r in got} == want
    assert sum(score < 1 for _, score in want.values()) > 5


def test_near_mentions_compare_few_windows(monkeypatch):
    """Names and texts of the same syllables share most letter pairs: under 3,000 windows a text are compared (29,063 before)."""
    from attestry.operators import scanning

    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice(("th", "he", "in", "er", "an", "re", "on", "nd")) for _ in range(rng.randint(1, 4))) for _ in range(n))
    keys, texts, seen, compare = [text(9)[:22] for _ in range(100)], [text(400) for _ in range(20)], [], scanning.NearFinder._compare

    def count(self, *args):
        seen.append(len(args[-3]))
        return compare(self, *args)

    monkeypatch.setattr(scanning.NearFinder, "_compare", count)
    list(scanning.near(86.0)(keys)(texts))
    assert 0 < sum(seen) / len(texts) < 3000
