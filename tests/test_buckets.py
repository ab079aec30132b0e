"""Buckets that similar paths share, against the row-by-row rule."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import similarity as sim
from attestry.operators import attributes as at
from attestry.operators.buckets import with_bucket

SCHEMA = "item_id bigint, idx int, classpath string, label string, value string, uom string, valid boolean"
NONE = "classpath string, label string"


def paths(rng, n):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    tops, out = [word() for _ in range(5)], []
    for _ in range(n):
        out.append(">".join([rng.choice(tops), word(), " ".join(word() for _ in range(rng.randint(1, 2)))]))
        kin = rng.choice(out)
        out.append(rng.choice([kin + "s", kin.rsplit(">", 1)[0] + ">" + word(), rng.choice(tops) + ">" + kin.rsplit(">", 1)[-1], word()]))
    return out + ["", "lone>", ">"]


def by_rows(rows, known, cutoff):
    """bucket of each row, one after the other"""
    have, out = {}, {}
    for path, label in known:
        have.setdefault(label, set()).add(path)
    for item, idx, path, label, value, _, valid in sorted(rows, key=lambda r: r[:2]):
        if not valid or not value or path is None or label is None:
            out[item, idx] = None
            continue
        own = have.setdefault(label, set())
        if path not in own:
            best = min(((-sim.category(path, o) if path and o else 0.0, o) for o in own), default=(0.0, None))
            path = best[1] if -best[0] >= cutoff else path
        own.add(path)
        out[item, idx] = path
    return out


@pytest.mark.parametrize("batch, block, cutoff", [(512, 2048, 55), (3, 7, 55), (5, 11, 80)])
def test_buckets_equal_the_rule_by_rows(spark, batch, block, cutoff):
    rng = random.Random(batch)
    pool = paths(rng, 45)
    rows = [(i // 3, i % 3, rng.choice(pool + [None]), rng.choice(["L", "M", "N", None]), rng.choice(["v", "w", "x", ""]), None, rng.random() < 0.9) for i in range(500)]
    known = [(p, rng.choice("LM")) for p in rng.sample(pool, 9)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(7)
    usable = F.col("valid") & (F.col("value") != "")
    got = {(r.item_id, r.idx): r.bucket for r in with_bucket(df, spark.createDataFrame(known, NONE), ["item_id", "idx"], usable, cutoff, batch, block).collect()}
    want = by_rows(rows, known, cutoff)
    assert got == want
    opened = {(b, r[3]) for r in rows if (b := want[r[:2]]) is not None} - set(known)
    assert len(opened) > 5 and any(b and b != r[2] for r in rows for b in [want[r[:2]]])


def test_no_rows_and_no_known_buckets(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert with_bucket(none, spark.createDataFrame([], NONE), ["item_id", "idx"], F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, 0, "a>b", "L", "v", None, True)], SCHEMA)
    assert [r.bucket for r in with_bucket(one, spark.createDataFrame([], NONE), ["item_id", "idx"], F.lit(True)).collect()] == ["a>b"]


def test_a_closer_bucket_that_opens_later_draws_rows_away(spark):
    """Both follow the rule: the known path serves until the nearer one has opened, and never for rows before."""
    known = [("tools>saws>hand saw blades", "L")]
    pool = ["tools>saws>hand saw blade kits", "zzz>qq>hand", "tools>saws>hand saw blades x"]
    rows = [(i, 0, p, "L", "v", None, True) for i, p in enumerate(pool * 2)]
    got = {(r.item_id, r.idx): r.bucket for r in with_bucket(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(known, NONE), ["item_id", "idx"], F.lit(True), 90).collect()}
    assert got == by_rows(rows, known, 90)


def test_stage_learns_one_value_for_similar_new_paths(spark):
    """The first value of a new path holds for a similar later path; a closed bucket without values accepts nothing."""
    extracted = [(1, "Finish", 0, "satin nickel", None), (2, "Finish", 0, "satin nickle", None), (3, "Finish", 0, "chrome", None), (4, "Tone", 0, "red", None)]
    items = [(1, "fixtures>taps>basin taps"), (2, "fixtures>taps>basin tap"), (3, "fixtures>taps>bath taps"), (4, "fixtures>taps>basin taps")]
    got = at.normalize_stage(
        spark.createDataFrame(extracted, "item_id bigint, label string, idx int, value string, uom string"),
        spark.createDataFrame(items, "item_id bigint, classpath string"),
        spark.createDataFrame([], "classpath string, label string, value string, uom string, seq bigint"),
        spark.createDataFrame([("fixtures>taps>basin tapz", "Tone")], NONE)).collect()
    assert {r.item_id: r.value for r in got} == {1: "satin nickel", 2: "satin nickel", 3: None, 4: None}
    assert {r.item_id: r.classpath for r in got}[2] == "fixtures>taps>basin tap"
