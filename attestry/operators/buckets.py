"""Buckets of controlled values for paths that have none of their own.

Row by row: a (path, label) with a bucket uses it.  Any other takes the bucket
of the most similar path that has this label by then, if the similarity reaches
the cutoff (ties: the path that sorts first), and otherwise opens its own, which
later rows can join.  So an opened bucket can draw rows away from a bucket that
served their path before.

As sets: which paths open is decided in rounds.  In a round each label settles
its next undecided paths, a bounded number in order of their first rows, and all
paths similar to those that opened are decided with them.  Then each path is
compared once with the known and once with the opened buckets of its label, in
blocks of bounded size on both sides; of the opened ones it keeps those that
were the best when they opened.  Rows only look up the last of these before
them.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.operators.namesearch import PathIndex
from attestry.params import DEFAULTS
from attestry.session import cut_lineage

BATCH = 512         # paths that a label settles in one round
BLOCK = 2_048       # paths on either side of a comparing task
_FOUND = "label string, classpath string, path string, score double"
_KEY = ["label", "classpath"]


def _best(cutoff: float, history: bool):
    """Finder of a block: the most similar path, or with `history` every path that was the most similar when its turn came."""

    names = ["label", "classpath", "path", "score"]

    def run(asked: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(keys):
            return pd.DataFrame([], columns=names)
        index = PathIndex(keys.sort_values(["turn", "path"])["path"].tolist())
        find = (lambda q: index.improving(q, cutoff)) if history else (lambda q: index.top(q, 1))
        label = asked["label"].iloc[0]
        return pd.DataFrame([(label, q, index.paths[at], score) for q in asked["classpath"] for at, score in find(q) if score >= cutoff], columns=names)

    return run


def _similar(asked: DataFrame, keys: DataFrame, cutoff: float, history: bool, block: int) -> DataFrame:
    """(label, classpath, path, score) of `asked` (label, classpath) and `keys` (label, path, turn) of equal labels."""
    counted = lambda df, name: df.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    parts = counted(asked, "rows").join(counted(keys, "cols"), "label")
    dealt = lambda n, c: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, "label").select(*_KEY, dealt("rows", "classpath").alias("r"), spread("cols").alias("c"))
    right = keys.join(parts, "label").select("label", "path", "turn", dealt("cols", "path").alias("c"), spread("rows").alias("r"))
    right = right.toDF(*right.columns)      # columns of its own where both sides come from one table
    on = ["label", "r", "c"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(_best(cutoff, history), _FOUND)


def _leaders(cutoff: float):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("turn")
        index, open_ = PathIndex(batch["classpath"].tolist()), []
        for i, path in enumerate(index.paths):
            if not index.reaches(path, open_, cutoff):
                open_.append(i)
        rows = batch[["label", "classpath", "turn"]].values.tolist()
        return pd.DataFrame([rows[i] for i in open_], columns=["label", "classpath", "turn"])

    return run


def _opened(pending: DataFrame, cutoff: float, batch: int, block: int) -> DataFrame | None:
    """(label, path, turn, first) of the paths that open a bucket; `turn` follows their first rows."""
    opened, done = None, 0
    pending = cut_lineage(pending)
    while not pending.isEmpty():
        order = Window.partitionBy("label").orderBy("first", "classpath")
        some = pending.withColumn("n", F.row_number().over(order)).where(F.col("n") <= batch).withColumn("turn", (F.col("n") + done).cast("bigint"))
        some = cut_lineage(some.drop("n"))
        led = some.select(*_KEY, "turn").groupBy("label").applyInPandas(_leaders(cutoff), "label string, classpath string, turn bigint")
        led = cut_lineage(some.join(led.select(*_KEY), _KEY, "left_semi").select("label", F.col("classpath").alias("path"), "turn", "first"))
        rest = pending.join(some.select(*_KEY), _KEY, "left_anti")
        near = _similar(rest.select(*_KEY), led, cutoff, False, block)
        pending = cut_lineage(rest.join(near.select(*_KEY), _KEY, "left_anti"))
        opened, done = led if opened is None else opened.unionByName(led), done + batch
    return opened


def bucket_history(asked: DataFrame, known: DataFrame, cutoff: float = DEFAULTS.category_cutoff, batch: int = BATCH, block: int = BLOCK) -> DataFrame:
    """(label, classpath, path, since): the buckets a path without one uses, in turn.

    `asked`: label, classpath, first (what orders rows; its least per path).
    `since` is the first row of the path that opened the bucket, null for known
    buckets; a path that opens its own has that one row.  Paths that are empty
    are similar to nothing.
    """
    known = cut_lineage(known.select("label", F.col("classpath").alias("path")).distinct())
    asked = cut_lineage(asked.join(known.withColumnRenamed("path", "classpath"), _KEY, "left_anti"))
    named = asked.where("classpath <> ''")
    base = _similar(named.select(*_KEY), known.where("path <> ''").withColumn("turn", F.lit(0).cast("bigint")), cutoff, False, block)
    base = cut_lineage(base.groupBy(*_KEY).agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("b")))
    own = lambda df: df.select("label", F.col("path").alias("classpath"), "path", F.col("first").alias("since"))
    blank = own(asked.where("classpath = ''").withColumn("path", F.col("classpath")))
    served = base.select(*_KEY, "b.s", "b.path", F.lit(None).cast(asked.schema["first"].dataType).alias("since"))
    opened = _opened(named.join(base.select(*_KEY), _KEY, "left_anti"), cutoff, batch, block)
    if opened is None:
        return served.drop("s").unionByName(blank)
    opened = cut_lineage(opened)
    others = named.join(opened.withColumnRenamed("path", "classpath"), _KEY, "left_anti").select(*_KEY)
    later = _similar(others, opened.select("label", "path", "turn"), cutoff, True, block).join(opened.select("label", "path", F.col("first").alias("since")), ["label", "path"])
    options = served.unionByName(later.select(*_KEY, (-F.col("score")).alias("s"), "path", "since"))
    before = Window.partitionBy(*_KEY).orderBy("since").rowsBetween(Window.unboundedPreceding, -1)     # nulls, that is known ones, come first
    beaten = F.min(F.struct("s", "path")).over(before)
    best = options.withColumn("beaten", beaten).where(F.col("beaten").isNull() | (F.struct("s", "path") < F.col("beaten")))
    return best.drop("s", "beaten").unionByName(own(opened)).unionByName(blank)


def with_bucket(values: DataFrame, known: DataFrame, order: list[str], usable: Column, cutoff: float = DEFAULTS.category_cutoff,
                batch: int = BATCH, block: int = BLOCK) -> DataFrame:
    """Add `bucket`: the path whose bucket serves the row, null for rows that are not `usable` or have no path.

    `known` holds the (classpath, label) of all buckets, empty and closed ones
    too; `order` are columns that order rows without ties.
    """
    at = F.struct(*order)
    ok = usable & F.col("classpath").isNotNull() & F.col("label").isNotNull()
    asked = values.where(ok).groupBy(*_KEY).agg(F.min(at).alias("first"))
    turns = bucket_history(asked, known, cutoff, batch, block).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("since", "path"))).alias("__turns"))
    past = F.filter("__turns", lambda t: t["since"].isNull() | (t["since"] <= at))
    # array_sort puts the null `since` of a known bucket first
    return values.join(turns, _KEY, "left").withColumn(
        "bucket", F.when(ok, F.coalesce(F.try_element_at(past, F.lit(-1))["path"], F.col("classpath")))).drop("__turns")
